"""Cross-tokenizer alignment against brute force."""

import collections
import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallystone.llm import queries, token_align


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())


def pieces_of(b, ids):
    out = []
    for i in ids:
        p = b.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        out.append(bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode())
    return out


def expected(rows, models):
    """Per row (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), with whole texts through both tokenizers and links by byte."""
    a, b = models
    alphabet = token_align.byte_alphabet()
    found = []
    for text in rows:
        spaced = b" " + (text or "").encode()
        ta = a.encode(" " + (text or ""), add_special_tokens=False).ids
        tb = b.encode(text or "")
        wa, wb = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ta], pieces_of(b, tb)
        if not text or b"".join(wa) != spaced or b"".join(wb) != spaced:
            found.append(None)
            continue
        at = [np.repeat(np.arange(len(w)), [len(x) for x in w]) for w in (wa, wb)]
        links = sorted(set(zip(*(x.tolist() for x in at), strict=True)))
        ends = [set(np.cumsum([len(x) for x in w]).tolist()) for w in (wa, wb)]
        groups, i, j = [], 0, 0
        for end in sorted(ends[0] & ends[1]):
            x, y = at[0][end - 1] + 1, at[1][end - 1] + 1
            groups.append(f"{','.join(map(str, ta[i:x]))}|{','.join(map(str, tb[j:y]))}")
            i, j = x, y
        found.append((len(ta), len(tb), len(groups), [(ta[i], tb[j]) for i, j in links], ";".join(groups)))
    count = collections.Counter(p for f in found if f for p in f[3])
    most = collections.defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if f is None else (*f[:3], len(f[3]), sum(count[p] == most[p[1]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) for f in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op11_token_alignment(spark, small, models):
    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, small).collect()}
    assert len(got) == len(rows) and got == dict(zip(rows, expected(rows.values(), models), strict=True))


ODD = ["", None, " ", "  ", " a  b ", "\n", "a\n\nb\n", "\n  indented\n\tx", "x▁y", "<|endoftext|> <s> </s> <0x0A> <unk>", "ﬁ ½ é́ 　x ", "😀 a😀b", "don't stop-it, l'été; C'est...", "aaaa" * 30, "1234567 89.5%", "straße\r\nx\x00y\x7f", "word " * 3000, "a"]


@pytest.mark.parametrize("head", [1 << 20, 5, 0])
def test_odd_texts_and_any_head(spark, models, head):
    rng = np.random.default_rng(4)
    parts = ["the", " cat", "'s", "\n", " ", "  ", "é", "ß", "123", "., ", "-", "▁", "\t", "Zürich", "😀", "ing", "un", "A", "<s>"]
    texts = ODD + ["".join(rng.choice(parts, int(rng.integers(1, 40)))) for _ in range(300)] + ["the same", "the same"]
    rows = [(None if k % 11 == 3 else k // 2, t, k, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int, Pairs string").repartition(3)
    out = token_align.aligned_links(docs, queries.tokenizer_file(), queries.piece_file(), head)
    want = sorted(((str(r[0]), *w) for r, w in zip(rows, expected(texts, models), strict=True)))
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in out.collect()) == want
    assert token_align.aligned_links(docs.where("rid < 0"), queries.tokenizer_file(), queries.piece_file(), head).count() == 0


def test_runs_are_jumped_and_groups_walked():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(n) < rng.choice([0.2, 0.9, 1.0])) + 1, n + 1) for _ in range(2))
        if rng.random() < 0.5:
            b = a.copy()
            b = np.delete(b, rng.integers(0, len(b) - 1)) if len(b) > 1 else b
        ga, gb, la, lb = token_align.align(a, b)
        common = np.intersect1d(a, b)
        assert np.array_equal(a[ga], common) and np.array_equal(b[gb], common)
        lows = [np.concatenate(([0], x[:-1])) for x in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(lows[0][i], lows[1][j]) < min(a[i], b[j])]
        assert list(zip(la.tolist(), lb.tolist(), strict=True)) == want
    assert [len(x) for x in token_align.align(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0, 0]
