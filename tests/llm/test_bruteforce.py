"""Plain Python versions of operators that SQL cannot express, on small random tables."""

import hashlib
import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex

from corpusloom.llm import pii, quality_crf, quality_rules, queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.01"


def words_of(text):
    return WORD.findall(text or "")


def quality_counts(text):
    """The base counts and the inputs of the rules, by their definitions."""
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated), "n_lines": len(lines), "n_ended": sum(bool(re.search(r"[.!?][\x20\x09-\x0D]*\Z", x)) for x in lines),
        "n_upper": len(re.findall("[A-Z]", text)), "n_digits": len(re.findall("[0-9]", text)), "n_alnum": len(regex.findall(r"[\p{L}\p{N}]", text)),
        "n_symbol_runs": len(re.findall(r"[#*$%&|<>]+", text)),
    }


def quality_votes(c):
    share = lambda a, b: c[a] / c[b] if c[b] else 0.0
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    mean = share("word_chars", "n_words")
    low = lambda x, good, bad: vote(x < good, x > bad)
    high = lambda x, good, bad: vote(x >= good, x < bad)
    return (
        high(c["n_words"], 80, 50), vote(3 <= mean <= 8.5, mean < 2.5 or mean > 11), low(share("n_symbols", "n_words"), 0.05, 0.2), low(share("n_symbol_runs", "n_words"), 0.05, 0.15),
        high(share("n_alnum", "word_chars"), 0.94, 0.9), low(share("n_dup_lines", "n_lines"), 0.1, 0.3), low(share("n_repeat_words", "n_words"), 0.2, 0.5),
        low(share("n_upper", "word_chars"), 0.1, 0.3), low(share("n_digits", "word_chars"), 0.05, 0.25), high(share("n_ended", "n_lines"), 0.5, 0.2),
    )


def quality_posteriors(votes):
    """EM document by document: each one's posterior, then the accuracies from all."""
    q = quality_rules
    k, prior, good, bad = len(votes[0]), q.START_PRIOR, [q.START_ON_GOOD] * len(votes[0]), [q.START_ON_BAD] * len(votes[0])

    def posterior(v):
        a, b = prior, 1 - prior
        for j, x in enumerate(v):
            if x:
                a *= good[j] if x > 0 else 1 - good[j]
                b *= 1 - bad[j] if x > 0 else bad[j]
        return a / (a + b)

    for _ in range(q.ROUNDS):
        p = [posterior(v) for v in votes]
        ng, nb = [], []
        for j in range(k):
            said = [(x, v[j]) for x, v in zip(p, votes, strict=True) if v[j]]
            g = (sum(x for x, y in said if y > 0) + q.PSEUDO_VOTES * q.START_ON_GOOD) / (sum(x for x, _ in said) + q.PSEUDO_VOTES)
            b = (sum(1 - x for x, y in said if y < 0) + q.PSEUDO_VOTES * q.START_ON_BAD) / (sum(1 - x for x, _ in said) + q.PSEUDO_VOTES)
            ng.append(min(q.MOST_ACCURACY, max(q.LEAST_ON_GOOD, g)))
            nb.append(min(q.MOST_ACCURACY, max(q.LEAST_ON_BAD, b)))
        moved = max(abs(a - b) + abs(c - d) for a, b, c, d in zip(ng, good, nb, bad, strict=True))
        prior, good, bad = min(0.98, max(0.5, sum(p) / len(p))), ng, nb
        if moved < 1e-4:
            break
    return [posterior(v) for v in votes]


def quality_verdicts(texts):
    """(counts, base_failed, posterior, kept) of each text."""
    counts = [quality_counts(t) for t in texts]
    p = quality_posteriors([quality_votes(c) for c in counts])
    failed = [c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for c in counts]
    return [(c, f, x, not f and x >= 0.5) for c, f, x in zip(counts, failed, p, strict=True)]


def odd_texts(rng, n):
    """Sentences, symbols, digits, capitals, repeated lines and phrases in all shares."""
    vocabulary = ["word", "other", "text", "Ähre", "running", "x", "of", "interesting", "naïve", "日本"]
    out = [None, "", " \n\t\x0b", "\n\n", "a"]
    for _ in range(n):
        lines, noise = [], rng.choice([0, 0, 0, 0.1, 0.4])
        for _ in range(rng.randrange(1, 14)):
            line = []
            for _ in range(rng.randrange(0, 16)):
                w = rng.choice(vocabulary) + str(rng.randrange(30)) * (rng.random() < 0.3) + "abcdefgh"[: rng.randrange(6)]
                line.append(rng.choice(["##", "$|", "12345", "SHOUT", "<a>"]) if rng.random() < noise else w)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line) + rng.choice([".", "!", "", ". "]))
        if rng.random() < 0.2:
            lines *= rng.randrange(2, 4)
        out.append("\n".join(lines))
    return out


def test_quality_rules(spark):
    texts = odd_texts(random.Random(1), 400)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_digest(d).collect()}
    want = quality_verdicts(texts)
    assert len(got) == len(texts) and len({x[3] for x in want}) == 2
    for i, (counts, failed, p, kept) in enumerate(want):
        assert {k: got[i][k] for k in quality_rules.COUNTS} == {k: counts[k] for k in quality_rules.COUNTS}, texts[i]
        assert (got[i].base_failed, got[i].kept) == (failed, kept) and math.isclose(got[i].p_good, p, abs_tol=1e-9)


def substring_rows(rows):
    """doc_id -> (n_words, n_removed, sha256 of the kept words)."""
    first = {}
    parts = {i: words_of(t) for i, t in rows}
    for i, w in parts.items():
        for a in range(len(w) - 49):
            key = tuple(w[a : a + 50])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in parts.items():
        gone = {a + k for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for k in range(50)}
        kept = [x for a, x in enumerate(w) if a not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("automaton", [20_000, 30])
def test_substring_dedup(spark, monkeypatch, automaton):
    """Passages around the least length, nested, overlapping, of few words, repeated in a document, and whole copies."""
    monkeypatch.setattr(substring_dedup, "AUTOMATON", automaton)
    rng = random.Random(automaton)
    passages = [[f"p{k}_{i}" for i in range(rng.choice([49, 50, 51, 80, 160]))] for k in range(12)]
    passages += [["a"] * 70, ["a", "b"] * 40, passages[3][5:] + passages[4][:30], [x.upper() for x in passages[0]]]
    rows = [(0, None), (1, ""), (2, "few words only")]
    for i in range(3, 160):
        w = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, 1, 20])
            w += [f"o{i}_{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 7, 60]))] + p[a : len(p) - rng.choice([0, 0, 3])]
        rows.append((rng.randrange(10**6) * 1000 + i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(10**10 + k, t) for k, (_, t) in enumerate(rows[5:25])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_digest(d).collect()}
    want = substring_rows(rows)
    assert got == want and len({x[1] for x in want.values()}) > 20


def test_windows_of_many_pieces_at_once(monkeypatch):
    """Pieces of a batch are hashed together; no window runs from one into the next."""
    rng, plain, calls = random.Random(3), substring_dedup._window_hashes, []
    monkeypatch.setattr(substring_dedup, "_window_hashes", lambda x: calls.append(1) or plain(x))
    pieces = [[rng.randrange(3) for _ in range(rng.choice([50, 51, 60, 84]))] for _ in range(60)]
    pieces += [p[: rng.randrange(50, len(p) + 1)] for p in pieces]
    numbers = [np.array(p, dtype=np.uint32).tobytes() for p in pieces]
    cols = {"anchor": list(range(120)), "doc_id": list(range(120)), "fp": [7] * 120, "start": [3 * i for i in range(120)], "words": numbers}
    batch = pa.RecordBatch.from_pydict(cols, pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("start", pa.int64()), ("words", pa.binary())]))
    got = [r for b in substring_dedup._piece_windows(iter([batch.slice(1)])) for r in b.to_pylist()]
    want = [(i, 3 * i + a, tuple(p[a : a + 50])) for i, p in enumerate(pieces) if i for a in range(len(p) - 49)]
    assert [(r["doc_id"], r["pos"]) for r in got] == [x[:2] for x in want] and {r["fp"] for r in got} == {7}
    classes = {(r["h"], x[2]) for r, x in zip(got, want, strict=True)}
    assert len(classes) == len({h for h, _ in classes}) == len({x for _, x in classes}) and len(calls) == 1


def test_equal_pieces_are_streamed_once(monkeypatch):
    """Copies of a piece go through the automata once, and each gets the stretches of its own document."""
    automata, streamed = substring_dedup._automata, []

    class Counted:
        def __init__(self, machine):
            self.machine = machine

        def iter(self, words):
            streamed.append(words)
            return self.machine.iter(words)

    monkeypatch.setattr(substring_dedup, "_automata", lambda x: (Counted(m) for m in automata(x)))
    number = lambda *w: np.array(w, dtype=np.uint32).tobytes()
    early, late = range(60), range(100, 155)
    passages = pd.DataFrame({"doc_id": [1, 5], "words": [number(*early), number(*late)]})
    pieces = pd.DataFrame({"doc_id": [1, 3, 5, 9], "fp": 0, "start": [0, 10, 20, 30], "words": [number(*early, 99, *late)] * 4})
    got = substring_dedup._locate((0, 0), pieces, passages)
    assert sorted(map(tuple, got[["doc_id", "a", "b"]].to_numpy().tolist())) == [(3, 10, 70), (5, 20, 80), (9, 30, 90), (9, 91, 146)]
    assert len(streamed) == 1


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, x in enumerate(reversed(digits)):
        y = int(x) * (1 + k % 2)
        total += y - 9 * (y > 9)
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii(spark):
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", "@d", ".", "..", "-", "+", " ", " ", "x@y.org", "1", "22", "256", "255", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 555", "(0)", "é", "😀",
              "日", "\n", "%", "_", "+49 30 1234567", "0" * 16, "6011000990139424", "000", "999.1.1.1", "1.2.3", "john.doe+tag@mail.example.com", "٣", ","]
    rows = [(0, None), (1, ""), *((i, "".join(rng.choices(pieces, k=rng.randrange(1, 60)))) for i in range(2, 500))]
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    seen = dict.fromkeys(KINDS, 0)
    for i, text in rows:
        base = [(k, m.start(), m.end()) for k, x in KINDS.items() for m in re.finditer(x, text or "") if valid(k, m.group())]
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [got[i]["n_" + k] for k in KINDS] == [sum(x[0] == k for x in base) for k in KINDS], text
        assert got[i].base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest(), (text, told, got[i].spans)
        assert set(told) <= set(got[i].spans.split(",")) | {""}
        for k, *_ in base:
            seen[k] += 1
    assert min(seen.values()) > 20


def test_crf_marginals():
    """Forward and backward sums of chains of 1 to 6 lines against all their labelings."""
    rng = np.random.default_rng(2)
    size = [1, 6, 3, 1, 5, 2]
    first = np.concatenate(([0], np.cumsum(size)))
    unary, turn = rng.normal(size=first[-1]) * 3, rng.normal(size=(2, 2)) * 2
    p, pairs = quality_crf.marginals(unary, turn, first)
    want_p, want_pairs = np.zeros(first[-1]), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        labels = list(itertools.product((0, 1), repeat=b - a))
        mass = np.array([math.exp(sum(unary[a + i] * y for i, y in enumerate(x)) + sum(turn[y, z] for y, z in itertools.pairwise(x))) for x in labels])
        for x, m in zip(labels, mass / mass.sum(), strict=True):
            want_p[a:b] += m * np.array(x)
            for y, z in itertools.pairwise(x):
                want_pairs[y, z] += m
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
def test_crf_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality IS NOT NULL").collect()}
    rows = [r for r in queries.queries()["op8_quality_crf"](spark, SMALL).filter("held_out").collect() if r.doc_id in labels]
    assert len(rows) > 50 and sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)


def near_groups(texts):
    """doc_id -> smallest doc_id reachable by links of similarity 0.75."""
    sets, top = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = words_of((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for _ in texts:
        before = dict(top)
        for i, j in itertools.combinations(texts, 2):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[i] = top[j] = min(top[i], top[j])
        if top == before:
            break
    return top


LOWER = {c: c + 32 for c in range(65, 91)}
BLANKS = " \t\n\x0b\x0c\r"


def without_repeated_lines(texts):
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    holders = {}
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)])
    return {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in texts.items()}


def aligned(item, text):
    """Whether the words of the text hold the item with a similarity of 0.5."""
    plain = lambda t: words_of(re.sub(r"[!-/:-@\[-`{-~]", "", t.translate(LOWER)))
    a, b = plain(item), plain(text)
    prev, best = [0.0] * (len(b) + 1), 0.0
    for x in a:
        row = [0.0]
        for j, y in enumerate(b):
            row.append(max(0.0, prev[j] + (1.0 if x == y else -0.5), prev[j + 1] - 0.5, row[j] - 0.5))
        prev, best = row, max(best, *row)
    return best >= len(a) / 2


def mix_targets(sizes):
    """Source -> target: shares by weight, clamped at three epochs, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, clamped = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        free = [s for s in order if s not in clamped]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in clamped)
        target = {s: 3 * sizes[s] if s in clamped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        clamped |= over


def test_pipeline(spark, tmp_path):
    """Every stage on what its predecessor kept, and all of them by ``run``."""
    import corpus_pipeline

    rng, texts = random.Random(9), []
    for i in range(150):
        lines = [" ".join(["".join(rng.choices("abcdefghij", k=6)) if rng.random() < 0.8 else rng.choice(["the", "of", "and"]) for _ in range(12)]).capitalize() + "." for _ in range(rng.randrange(5, 12))]
        if i % 4 == 0:
            lines.insert(1, rng.choice(["  This line of the page stands in many of the documents here.", "Another line that is shared by many of the documents here\t"]))
        texts.append("\n".join(lines))
    items = [" ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(30)) for _ in range(3)]
    for i in range(0, 30):
        texts.append(texts[i] if i % 2 else texts[i] + " tail.")
    for i in range(40, 52):
        cut = ["zz" if j % 6 == 5 else w for j, w in enumerate(items[i % 3].split())]
        texts.append(texts[i] + "\n" + " ".join(items[i % 3].split()[: (9, 20, 30)[i % 3]] if i < 46 else cut) + ".\n" + texts[i + 20])
    texts += ["### $$ || <a> ## " * 20, "too short", None, "", "the same words here " * 40, "12345 67890 " * 60]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(n + 1, texts[k], "en", rng.choice(["a", "b", "c", "d", None]) if rng.random() < 0.6 else "hot", len(texts[k] or "")) for n, k in enumerate(order)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def quality(docs):
        verdict = quality_verdicts([t for t in docs.values()])
        return {i: t for (i, t), v in zip(docs.items(), verdict, strict=True) if v[3]}

    def one_of_each(docs):
        return {i: docs[i] for i, top in near_groups(docs).items() if i == top}

    def clean(docs):
        return {i: t for i, t in docs.items() if not any(aligned(x, t) for x in items)}

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [len(rows)]
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:-1], (quality, without_repeated_lines, one_of_each, clean), strict=True):
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, str(tmp_path))
        kept = out.collect()
        assert out.columns == now.columns and {r.doc_id: r.text for r in kept} == plain(before) != before
        now = spark.createDataFrame([tuple(r) for r in kept], schema)
        sizes.append(len(kept))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 90
    given = {r.doc_id: r for r in now.collect()}
    size = {i: len(words_of(r.text)) for i, r in given.items()}
    per = {s: sum(size[i] for i, r in given.items() if r.source == s) for s in {r.source for r in given.values()}}
    target = mix_targets(per)
    mix = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()}
    for s, t in target.items():
        taken = sum(r.taken for r in mix.values() if r.source == s)
        assert abs(taken - t) <= max(size.values()) and all(math.isclose(r.target, t) for r in mix.values() if r.source == s)
    assert all(r.text == given[i].text and r.taken == r.copies * size[i] and 1 <= r.copies <= 3 for i, r in mix.items())
    assert {r.doc_id: r.copies for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: r.copies for i, r in mix.items()}
