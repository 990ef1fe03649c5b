"""Odd inputs and brute-force versions of the training-data operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, line_dedup, mixing, ngram_join, pii, quality_crf, quality_rules, substring_dedup, url_filter, warc_fixity

LONG = "a line that is certainly longer than forty code points in all"
BASE = " ".join(f"w{i}" for i in range(120))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, k_id long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{LONG}\nown line {i}", "en", "s", 1) for i in range(1, 7)]
    rows += [(10, BASE, "en", "a", 1), (11, BASE + " tail", "en", "a", 1), (12, BASE, "en", None, 1), (13, None, None, None, None), (14, "", "en", "b", 0), (15, "x\ny", "en", "b", 3)]
    rows += [(None, BASE, "en", "a", 1), (11, BASE + " tail", "en", "a", 1), (16, "z " * 30000, "en", "long", 60000)]
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lines(docs, empty):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_digest(docs).collect()}
    assert got[1] == (2, 1, hashlib.sha256(b"own line 1").hexdigest()) and got[6][1] == 0
    assert got[13] == (1, 0, hashlib.sha256(b"").hexdigest()) == got[14]
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and {r.text for r in out.filter("doc_id = 2").collect()} == {"own line 2"}
    assert line_dedup.line_dedup_digest(empty).count() == 0


def test_quality_counts(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_digest(docs).collect()}
    assert (got[16].n_words, got[16].n_repeat_words, got[16].base_failed) == (30000, 30000, True)
    assert got[13].n_words == 0 and not got[13].kept and got[10].n_words == 120 and got[10].n_repeat_words == 0
    assert quality_rules.quality_digest(empty).count() == 0 and quality_rules.filter_quality(docs).columns == docs.columns


def test_mix(docs, empty):
    rows = mixing.mix_digest(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_digest(docs).collect()), key=repr)
    total = sum(r["size"] for r in rows)
    targets = {r.source_size: r.target for r in rows}
    assert all(t <= 3 * s for s, t in targets.items()) and total > 0
    assert mixing.mix_digest(empty).count() == 0 and mixing.mix_documents(docs).count() <= len(rows)


def test_near_duplicates(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join_digest(docs).collect()}
    assert got[10] == (116, 10) and got[11] == (117, 10) and got[12] == (116, 10)
    assert got[13] == (0, 13) and got[15] == (1, 15) and got[None][1] is None
    assert ngram_join.ngram_join_digest(empty).count() == 0
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {10} == {r.doc_id for r in kept.collect()} & {10, 11, 12}


def test_near_duplicates_by_brute_force(spark):
    """Edited copies of one text on both sides of the threshold, in several sizes."""
    rng, rows = random.Random(5), []
    for i in range(260):
        w = [f"w{k}" for k in range(rng.choice([9, 40, 63, 64, 65, 90, 120]))]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        w += [f"t{i}_{k}" for k in range(rng.choice([0, 0, 4, 15]))]
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}
    # the candidates by rare shingles alone miss no link
    d = spark.createDataFrame(rows, "doc_id long, text string")
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
    ids = [int(ngram_join._class_of(s)[0]) for _, _, s in ngram_join._sets(iter([batch]))]
    first = {c: i for i, c in reversed(list(enumerate(ids)))}
    nodes = ngram_join._classes(d.mapInArrow(ngram_join._signatures(0.0), ngram_join.SIGNATURE).filter("n > 0"))
    near = [(ids[j], ids[i]) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    links = {(min(p), max(p)) for p in near if p[0] != p[1]}

    def reached(edges):
        """The least class that each one reaches."""
        top = {c: c for c in first}

        def root(x):
            while top[x] != x:
                x = top[x]
            return x

        for u, v in edges:
            a, b = sorted((root(u), root(v)))
            top[b] = a
        return {c: root(c) for c in first}

    # each class alone, and components of seven around a hub, most of whose members aren't similar
    for hub in ({c: c for c in first}, {c: sorted(first)[k % 7] for k, c in enumerate(sorted(first))}):
        old = [(h, c) for c, h in hub.items() if c != h]
        placed = spark.createDataFrame(list(hub.items()), "id long, comp long")
        found, rest = ngram_join._rare_pairs(
            d, nodes, placed, spark.createDataFrame(old, "u long, v long"), spark.createDataFrame([(c, h) for h, c in old], "node long, component long")
        )
        known = {(r.u, r.v) for r in found.collect()}
        met = {(r.u, r.v) for r in rest.collect()}
        assert links and known and known <= links
        assert reached([*old, *known, *(met & links)]) == reached([*old, *links])


def test_near_duplicates_of_few_shingles(spark):
    """Texts of 7 and 8 (3/4), 8 and 9 words (4/5), one inside the other: each pair is a link."""
    rng, rows = random.Random(7), []
    for i in range(1200):
        w = [f"{rng.randrange(10**9):x}" for _ in range(8 + i % 2)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1] if rng.random() < 0.5 else w[1:]))]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_duplicates_share_enough_keys():
    """All similar pairs have as many common keys as either needs, whatever the words and sizes."""
    rng, texts = random.Random(8), []
    for i in range(6000):
        w = [f"{rng.randrange(10**9):x}" for _ in range(8 if i % 3 == 0 else 5 + i % 20 if i % 3 == 1 else rng.randrange(60, 400))]
        v = w[rng.randrange(3) : len(w) - rng.randrange(3)]
        for _ in range(rng.randrange(0, max(2, len(w) // 30))):
            v[rng.choice([0, -1]) if len(v) < 30 else rng.randrange(len(v))] = f"e{rng.randrange(99)}"
        if rng.random() < 0.2:
            v += [f"t{k}" for k in range(rng.randrange(len(w) // 3))]
        texts += [" ".join(w), " ".join(v)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sets = [s for _, _, s in ngram_join._sets(iter([batch]))]
    common = [np.unique(np.concatenate(sets)[::7]), np.unique(np.concatenate(sets)[::50])]
    keys = {int(ngram_join._class_of(s)[0]): set() for s in sets}
    few, bits = set(), 8
    for b in ngram_join._keys(common, bits)(iter([batch])):
        for place, k, c in zip(b.column("place").to_pylist(), b.column("keys").to_pylist(), b.column("classes").to_pylist(), strict=True):
            for x, y in zip(np.frombuffer(k, dtype=np.uint32).tolist(), np.frombuffer(c, dtype=np.int64).tolist(), strict=True):
                keys[y].add((place, x >> 3))
                if x & 2:
                    few.add(y)
    classes = [int(ngram_join._class_of(s)[0]) for s in sets]
    similar = [i for i in range(0, len(sets), 2) if 4 * len(np.intersect1d(sets[i], sets[i + 1])) >= 3 * len(np.union1d(sets[i], sets[i + 1]))]
    assert len(similar) > 2000
    for i in similar:
        for me, other in ((i, i + 1), (i + 1, i)):
            need = 1 if classes[me] in few else ngram_join._need(len(sets[me]))
            assert len(keys[classes[me]] & keys[classes[other]]) >= need


def test_substrings(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_digest(docs).collect()}
    assert got[10][:2] == (120, 0) and got[12][:2] == (120, 120) and got[None][:2] == (120, 0)
    assert got[11] == (121, 120, hashlib.sha256(b"tail").hexdigest())
    assert substring_dedup.substring_digest(empty).count() == 0


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(f"W{i}," for i in range(20, 50))), (2, None), (3, "never seen words in any of these documents at all")], "item_id long, text string")
    edited = spark.createDataFrame([(50, " ".join("zz" if i % 8 == 0 else f"w{i}" for i in range(20, 50)), "en", "a", 1, "c", 7)], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs.unionByName(edited), items).collect()}
    assert got == {(d, 1) for d in (10, 11, 12, None, 50)}
    assert {10, 11, 12}.isdisjoint(r.doc_id for r in decontamination.drop_leaking(docs, items).collect())
    assert decontamination.find_leaks(empty, items).count() == 0 and decontamination.find_leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("copies, intact", [(6, 0), (1000, 0), (1000, 1)])
def test_leaks_by_brute_force(spark, copies, intact):
    """Groups of edited copies and half quotes, as many as there are, against alignment with whole documents."""
    rng, item, quoted = random.Random(copies), [f"w{i}" for i in range(30)], [f"q{i}" for i in range(30)]
    edited = ["zz" if i % 8 == 4 else w for i, w in enumerate(item)]
    texts = [["a", *edited, f"own{k}"] for k in range(copies)] + [["b", *item]] * intact
    texts += [[f"x{rng.randrange(50)}" for _ in range(20)] + quoted[:n] + ["y"] * 9 for n in (5, 12, 14, 15, 16) for _ in range(7)]

    def score(a, b):
        prev, best = [0.0] * (len(b) + 1), 0.0
        for x in a:
            row = [0.0]
            for j, y in enumerate(b):
                row.append(max(0.0, prev[j] + (1.0 if x == y else -0.5), prev[j + 1] - 0.5, row[j] - 0.5))
            prev, best = row, max(best, *row)
        return best

    want = {(i, k): s / 30 for i, t in enumerate(texts) for k, x in ((1, item), (2, quoted)) if (s := score(x, t)) >= 15}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(quoted))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(d, items).collect()}
    assert len(want) == copies + intact + 14 and got == pytest.approx(want)


def test_leaks_by_edit_rate(spark):
    """Words replaced, added and left out at random, and every fourth word replaced; short items inside long texts."""
    rng, texts, rates = random.Random(3), [], {}
    items = [[f"i{k}x{j}" for j in range(rng.randrange(15, 60))] for k in range(12)]
    for rate in (0.1, 0.2, 0.3, 0.4):
        for k in range(120):
            out = []
            for w in items[k % 12]:
                if rng.random() >= rate:
                    out.append(w)
                else:
                    out += rng.choice([[f"z{rng.randrange(999)}"], [], [w, f"z{rng.randrange(999)}"]])
            rates[len(texts)] = rate
            texts.append(["pre"] * rng.randrange(40) + out + ["post"] * rng.randrange(40))
    texts += [["z" if j % 4 == 3 else w for j, w in enumerate(x)] for x in items]
    texts += [["q"] * 50 + ["one", "two", "three"] + ["q"] * 50]
    a = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(50, "One two, three!"), (51, "one two"), (52, "pre")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(a, b).collect()}
    index = {w: n for n, w in enumerate(sorted({w for t in texts for w in t} | {w for x in items for w in x}))}
    code = lambda x: np.array([index[w] for w in x])
    want = {(i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if decontamination.smith_waterman(code(x), code(t)) >= len(x) / 2}
    assert got - {(len(texts) - 1, 50)} <= want and (len(texts) - 1, 50) in got and {(480 + k, k) for k in range(12)} <= got
    for rate in (0.1, 0.2, 0.3, 0.4):
        mine = {p for p in want if rates.get(p[0]) == rate}
        assert len(mine & got) >= (0.99 if rate < 0.4 else 0.95) * len(mine) and len(mine) > 30, (rate, len(mine & got), len(mine))


def test_pii(spark, empty):
    t = "a@b.com_c@d.e x 1.2.3.4.5.6.7.8 300.1.1.1 y 4111 1111 1111 1111 x +1 (017) 555-7713 () é"
    d = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_digest(d).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 2, 1, 1)
    first = re.search(r"\+1 \(017\) 555-7713", t)
    assert f"phone:{first.start()}:{first.end()}" in got[1].spans and got[2].spans == "" == got[3].spans
    assert pii.pii_digest(empty).count() == 0


def test_crf(spark, empty):
    good = [(i, "\n".join(f"This is sentence {k} of a fine text." for k in range(6))) for i in range(60)]
    bad = [(i, "\n".join("### $$$ %%% |||" for _ in range(6))) for i in range(60, 120)]
    d = spark.createDataFrame([*good, *bad, (200, None), (201, "")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_crf.score_documents(d, lab).collect()}
    assert all(got[i].predicted == int(i < 60) for i in range(120)) and 0 <= got[200].score == got[201].score <= 1
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))
    assert quality_crf.score_documents(empty, lab).count() == 0 and quality_crf.score_documents(d, lab.limit(0)).count() == 122


def test_urls(spark):
    link = '<html><link rel="canonical" href="http://b.net/x"></html>'
    p = spark.createDataFrame([(1, "http://a.com/1", link), (2, "http://B.net/x?q", ""), (3, "http://c.org/fr/1", link), (4, None, None), (5, "nourl", ""), (6, "http://d.com/", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(p).collect()}
    assert got == {1: ("a.com", None, "block"), 2: ("b.net", "net/", "block"), 3: ("c.org", "org/fr/", "allow"), 4: ("", None, "allow"), 5: ("", None, "allow"), 6: ("d.com", None, "allow")}
    assert url_filter.judge_urls(p.limit(0)).count() == 0


def test_url_aliases(spark):
    """Links as pages write them, all tags, repeated rows, extra columns and long html, against SQL and by hand."""
    import duckdb

    tag = '<LINK class=x rel="nofollow canonical" href="{}">'.format
    pad = "<p>text</p>" * 5000
    rows = [
        (1, "http://example.com/q", tag("/de/1"), "block"), (2, "http://example.com/a/b", tag("../de/2"), "block"), (3, "http://example.com/x/y?z=1", tag("./c/../../de/./3"), "block"),
        (4, "http://a.com/1", tag("//b.net/?a=1&amp;b=2"), "block"), (5, "http://b.com/1", tag("http://c.com/2") + pad + tag("http://d.com/3#top"), "block"),
        (6, "HTTP://D.com/3", "<meta content='0; URL=/4?x=&#38;' http-equiv=refresh>", "block"), (7, "http://d.com/4?x=&", tag("http://e.net/"), "block"),
        (8, "http://c.com/2", "", "block"), (9, "http://f.com/1?k=1", tag("?k=2"), "allow"), (10, "http://f.com/1?k=2", tag("mailto:a@b.net"), "allow"),
        (11, "http://c.com/2", None, "block"), (11, "http://c.com/2", None, "block"), (12, "http://g.com", tag("de"), "allow"), (13, "http://g.com/de", tag(""), "allow"),
        (14, "http://g.com/dir/", tag(".."), "allow"), (15, "http://h.com/" + "x" * 3000, pad + "<link rel=stylesheet href=http://b.net/s>", "allow"), (16, None, tag("http://b.net/"), "allow"),
        (17, "http://g.com/", tag("http://www.example.net/en/1"), "allow"), (18, "http://www.example.net/en/1", tag("http://e.net/1"), "allow"),
    ]
    rows[14] = (*rows[14][:3], "block")
    rows[-2] = (*rows[-2][:3], "block")
    p = spark.createDataFrame([(*r[:3], "clash", "clash") for r in rows], "page_id long, url string, html string, host string, u string")
    got = [(r.page_id, r.verdict) for r in url_filter.judge_urls(p).orderBy("page_id").collect()]
    assert got == [(r[0], r[3]) for r in rows]
    table = p.select("page_id", "url", "html").toPandas()
    con = duckdb.connect()
    con.register("pages", table)
    assert [(a, e) for a, *_, e in sorted(con.execute(url_filter.URL_SQL).fetchall())] == got


def test_url_links_as_browsers_read_them(spark):
    """Base, comments, scripts and entities, and the same by SQL."""
    import duckdb

    can = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.com/1", '<base target=x><base href="http://b.net/"><base href="http://c.com/">' + can.format("y"), "block"),
        (2, "http://a.com/2", "<!-- " + can.format("http://b.net/") + " -->", "allow"),
        (3, "http://a.com/3", "<!-- x --> " + can.format("http:&#x2F;&#x2f;b.net&#47;"), "block"),
        (4, "http://a.com/4", "<script>'" + can.format("http://b.net/") + "'</script><style>" + can.format("http://b.net/"), "allow"),
        (5, "http://a.com/5", "<SCRIPT>x</SCRIPT >" + can.format("//b.net/?a=1&#38;amp;b"), "block"),
        (6, "http://a.com/6", can.format("/t?x=1&#38;amp;b"), "block"),
        (7, "http://a.com/t?x=1&amp;b", can.format("http://b.net/"), "block"),
        (8, "http://a.com/t?x=1&b", "", "allow"),
        (9, "http://a.com/9", '<base href="/dir/x">' + can.format("../&#233;&#xE9;&#128512;&#0;"), "block"),
        (10, "http://a.com/éé\U0001f600\ufffd", can.format("http://b.net/9"), "block"),
        (11, "http://a.com/11", "<!-- never closed " + can.format("http://b.net/"), "allow"),
        (12, "http://a.com/12", '<base href="">' + can.format("?q&quot;"), "allow"),
    ]
    p = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = [(r[0], r[3]) for r in rows]
    assert [(r.page_id, r.verdict) for r in url_filter.judge_urls(p).orderBy("page_id").collect()] == want
    con = duckdb.connect()
    con.register("pages", p.toPandas())
    assert [(a, e) for a, *_, e in sorted(con.execute(url_filter.URL_SQL).fetchall())] == want


def test_mix_keeps_a_callers_columns(spark):
    d = spark.createDataFrame([(1, "a b c", "s", 99, "mine", 7), (2, "d", "t", 98, None, 8)], "doc_id long, text string, source string, size long, target string, mix_size int")
    got = {r.doc_id: r for r in mixing.mix_documents(d).collect()}
    assert got and all((r.size, r.target, r.mix_size) == {1: (99, "mine", 7), 2: (98, None, 8)}[k] for k, r in got.items())
    assert all(r.mix_mix_size == {1: 3, 2: 1}[k] and r.taken == r.copies * r.mix_mix_size and r.mix_target > 0 for k, r in got.items())


def _warc(i, url, html):
    body = (html or "").encode()
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_fixity(spark):
    """Changed, shortened, lost and stray records in mid-file, by the rule itself."""
    rows = [(i, f"http://h/{i}", "" if i % 7 == 0 else "é<html>" + "x" * 700 * (i % 5)) for i in range(1200)]
    p = spark.createDataFrame([(*r, "clash", 1) for r in rows + [(None, None, None)] * 3], "page_id long, url string, html string, file string, offset long")
    got = warc_fixity.audit_digest(p).collect()
    kind = {i: zlib.crc32(str(i).encode()) % 97 for i in range(1200)}
    want, at = [], {}
    for i, url, html in rows:
        body = _warc(i, url, html)
        changed = kind[i] == 5 or kind[i] == 7 and html
        want.append((i, f"crawl-{i // 500:05d}.warc", at.get(i // 500, 0), len(body), hashlib.sha256(body).hexdigest(), "corrupt" if changed else "missing" if kind[i] == 6 else "ok"))
        at[i // 500] = at.get(i // 500, 0) + len(body)
    extra = {i + warc_fixity.STRAY for i, k in kind.items() if k == 8}
    assert sorted(tuple(r) for r in got if r.page_id is not None and r.status != "extra") == want and len({x[5] for x in want}) == 3
    assert extra and {r.page_id for r in got if r.status == "extra"} == extra
    assert [r.status for r in got if r.page_id is None] == ["ok"] * 3 and len(got) == 1203 + len(extra)
    a = warc_fixity.export_records(p)
    cut = a.filter(F.col("page_id").isNull() | (F.col("page_id") != 7))
    assert [r.status for r in warc_fixity.locate_differences(a, cut).collect()] == ["missing"]
    assert [r.status for r in warc_fixity.locate_differences(cut, a).collect()] == ["extra"]
    bare = spark.createDataFrame([(None, None, "d1"), (None, None, "d2"), ("f", 5, "d3"), ("f", 5, "d3")], "file string, offset long, digest string")
    assert {(r.digest_a, r.digest_b, r.status) for r in warc_fixity.locate_differences(bare, bare.filter("digest <> 'd2'")).collect()} == {("d2", None, "missing")}
    assert warc_fixity.locate_differences(a, a.limit(0)).count() == 1203
    assert warc_fixity.audit_digest(p.limit(0)).count() == 0
