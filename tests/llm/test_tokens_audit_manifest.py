"""Byte-level BPE, filter audit and Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
import tiktoken

public_tokenizers = pytest.importorskip("public_tokenizers")

from corpusloom.llm import byte_bpe, filter_audit, merkle_manifest  # noqa: E402

BLANK = "[^\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, cut string, part string"


def _docs(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def tokenizer():
    ranks = byte_bpe.vocabulary(byte_bpe.default_path()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "日", "9", "½", "!", "$", "　", "😀", "\x1c", "\x85", "don't", "'S", "्", "۳"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_are_those_of_the_tokenizer_library(spark, tokenizer):
    long_text = "x" * 3000 + " " + "word and word " * 200_000 + "ab" * 5000  # over several parts
    texts = [*_random_texts(3000, 3), "", None, long_text, "<|endoftext|>", "same", "same"]
    docs = _docs(spark, [(i if i % 7 else None, t, None, None, None) for i, t in enumerate(texts)])
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip_digest(docs).collect())
    want = []
    for i, t in enumerate(texts):
        ids = tokenizer.encode_ordinary(t or "")
        want.append(((i if i % 7 else None) or -1, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(t or "")))
    assert got == sorted(want)


def test_tokens_of_the_given_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids) for r in byte_bpe.encode(docs).collect()}
    for r in docs.collect():
        ids = tokenizer.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), np.array(ids, dtype="<u4").tobytes())


def test_trees_side_by_side_merge_as_single_ones(tokenizer):
    words = byte_bpe.vocabulary(byte_bpe.default_path())
    rng = random.Random(5)
    pieces = list({"".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 64))).encode() for _ in range(2000)} - set(words.ranks))
    for size in (4, 8, 16, 32, 64):
        some = [p for p in pieces if size // 2 < len(p) <= size]
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in byte_bpe.encode_pieces(some, size, words)]
        assert got == [byte_bpe.encode_piece(p, words.ranks) for p in some] == [tokenizer.encode_ordinary(p.decode()) for p in some]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(byte_bpe, "span_hashes", lambda raw, a, b: np.zeros(len(a), dtype=np.uint64))
    raw = np.frombuffer(b"ab cd ab x", dtype=np.uint8)
    start, end = np.array([0, 2, 5, 8]), np.array([2, 5, 8, 10])
    at, back = byte_bpe._distinct(raw, start, end)
    assert [raw[start[k] : end[k]].tobytes() for k in at[back]] == [b"ab", b" cd", b" ab", b" x"]


def test_no_rows_no_tokens(spark):
    assert byte_bpe.round_trip_digest(_docs(spark, [])).collect() == []


# ------------------------------------------------------------------ audit


def _audit(docs, labels):
    """Every order by itself, document by document."""
    fails, out = [], {}
    for i, (doc_id, text, lang) in enumerate(docs):
        t = text or ""
        w = re.findall(BLANK, t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in docs) else set()
        told = [x for x in labels if x[0] == doc_id and doc_id is not None]
        fails.append((lang or "", f, any(x[1] == 1 for x in told), any(x[2] == 1 for x in told)))
    for part in {x[0] for x in fails}:
        removed_by = {c: 0 for c in "ABCDE"}
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                before = set(order[:k])
                here = [x for x in fails if x[0] == part]
                gone = [x for x in here if c in x[1] and not x[1] & before]
                removed_by[c] += len(gone)
                out[part, order, k + 1] = [
                    sum(not x[1] & (before | {c}) for x in here), len(gone), sum(c in x[1] and bool(x[1] & before) for x in here),
                    sum(x[1] == {c} for x in here), sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                out[part, order, k + 1].append(removed_by[c])
    return out


def test_audit_of_every_order(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        n = rng.choice([0, 5, 199, 200, 230])
        w = [f"w{rng.randrange(rng.choice([3, 400]))}" for _ in range(n)]
        if rng.random() < 0.3:
            w = [x.upper() for x in w]
        t = rng.choice([" ", "\n", "\t "]).join(w) + rng.choice(["", "", " #", "|", "é"])
        rows.append((rng.randrange(90), rng.choice([t, t, t, None, rows[-1][1] if rows else t]), rng.choice(["en", "de", None, ""])))
    rows += [(None, "no id", "en"), (None, "no id", "en"), (3, "no id", "de"), rows[0]]
    labels = [(rng.randrange(90), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(80)] + [(None, 1, 1)]
    docs = _docs(spark, [(i, t, lang, None, None) for i, t, lang in rows])
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == _audit(rows, labels)
    assert len(got) == 600 * 3


def test_audit_of_nothing(spark):
    assert filter_audit.audit(_docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_audit_of_many_parts(spark):
    """More rows in the recursion than Spark's limit lets through."""
    docs = _docs(spark, [(i, "few words", f"l{i:04d}", None, None) for i in range(3200)])
    got = filter_audit.prefix_metrics(filter_audit.mask_cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got.count() == 3200 * 325


# ------------------------------------------------------------------ manifest


def _told(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _up(nodes):
    """(root, proof of each leaf as lists of (before, after))."""
    proofs, groups, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], nodes
    while len(level) > 1:
        above, joined = [], []
        for k in range(0, len(level), 3):
            run = level[k : k + 3]
            for j in range(len(run)):
                for leaf in groups[k + j]:
                    proofs[leaf].append((run[:j], run[j + 1 :]))
            above.append(sha("".join(run)))
            joined.append([x for g in groups[k : k + 3] for x in g])
        level, groups = above, joined
    return level[0], proofs


def _manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, _told(r, r[1])))
        parts.append((own, *_up([_told(r, r[1]) for r in own])))
    root, over = _up([p[1] for p in parts])
    out = []
    for (own, sub, proofs), outer in zip(parts, over, strict=True):
        for r, p in zip(own, proofs, strict=True):
            p = p + outer
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = _told(r, text)
            for a, b in p:
                h = sha("".join(a) + h + "".join(b))
            leaf = _told(r, r[1])
            out.append((str(r[0]), leaf, sub, root, sha("".join("".join(a + b) for a, b in p)), h, h == root))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 130])
def test_manifest(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "b", "é", "", None, f"s{rng.randrange(20)}"])
        rows.append((rng.choice([i, i, i, 5, None, -i]), rng.choice([None, "", "plain", "two\nlines", "日\n\n", "x" * 5000]), rng.choice(["en", None]), source, rng.choice([None, 7])))
    rows += rows[:1]
    got = merkle_manifest.manifest_digest(_docs(spark, rows).repartition(3)).collect()
    assert sorted((str(r[0]), *list(r)[1:]) for r in got) == _manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest_digest(_docs(spark, [])).collect() == []


def test_siblings_come_from_intervals(spark):
    """A node of the last run of four leaves has no sibling, but the step is there."""
    leaves = spark.createDataFrame([(i, f"{i:064x}", "s") for i in range(4)], "doc_id long, h string, source string")
    rows, root = merkle_manifest.inclusion_proofs(leaves)
    got = {r.doc_id: [(len(s.before) // 64, len(s.after) // 64) for s in r.proof] for r in rows.collect()}
    assert got == {0: [(0, 2), (0, 1)], 1: [(1, 1), (0, 1)], 2: [(2, 0), (0, 1)], 3: [(0, 0), (1, 0)]}
    assert root == _up([f"{i:064x}" for i in range(4)])[0]
