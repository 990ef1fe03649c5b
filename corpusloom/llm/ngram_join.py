"""N-gram Jaccard join by parity sketches.

Every document is its set of distinct 5-word shingles. With sizes a <= b, two sets
of Jaccard similarity 3/4 or more differ in at most (a + b) / 7 shingles. A parity
sketch XORs the hash of each shingle into one of B blocks of 64 bit planes, so that
a shingle of the symmetric difference changes one block: the number of blocks that
differ, and the Hamming distance of a one-hot parity sketch, are both lower bounds
of the symmetric difference. By the pigeonhole principle a similar pair agrees in
one of the first D + 1 non-empty blocks of either document, D being the largest
distance that the document's size allows. These blocks are the join keys, within
bands of size; candidates must then pass the Hamming bound and are verified on the
whole sets. No link is lost, but for equal 64-bit hashes.

Hot content: shingles that a large share of documents holds are left out of the
sketch for as long as D + 1 blocks remain without them, which keeps the bound,
since both sides leave out the same ones. Documents made of little else (a large
group of near copies) meet in later tiers that leave out less. Where D + 1 blocks
don't come together even with nothing left out (mostly sets of 3 or 4 shingles), the
bound says nothing, and the first n - 3/4 n + 1 shingles in the order of their hashes
are keys as well: similar sets share one of these.

Keys. Sets are classes: copies have one class id, a 64-bit hash of the set, and make
each key once. A document emits a few keys more than D + 1, so that similar pairs
agree in several (see ``_need``); documents with fewer shared keys than that are out
before any pair is made. A task combines its keys before the shuffle: of the classes
with one key it sends on a leader alone, so that the place where a key comes together
gets no more than a row for each task, and what it leaves out is known to be shared
already. Keys travel in packed arrays, dealt to as many places as their number asks.

Instead of all pairs of a key, each key first yields a star around one class, that
of the smallest document. Links of the stars make components, and only classes of keys that still hold
several components are looked at again. Stars around the set of each rare shingle that
has kept most of what it shares join what is left of families of edited copies
(``_rare_stars``). What then are different components meets in pairs, by rare shingles: with all
shingles in one order, rarest first, similar sets share one within the first (n - 3
(n + m) / 7) + 1 of either, n and m being the sizes. A shingle that no other of these
documents has takes a place and meets nobody, so a document with many of its own is
out, however common the rest is. What meets passes the Hamming bound and is verified
like any candidate. Components come from distributed star contraction.

Where a large component meets other sets, members and strangers aren't paired. Both
are compared with the component's hub, and kept as what they differ in from it. With
differences of x and y shingles, two sets differ in x + y less twice what these have in
common; a stranger that isn't similar to the hub is only similar to a member that has
much of its difference in common with it. These differences meet by their rare
shingles, in the same manner.

Defined results: without words or text a document has an empty set and is linked
with nothing; documents with fewer than five words have one shingle; rows that
repeat a ``doc_id`` are one node and each returned; a row without ``doc_id`` is
linked with nothing (component_id null); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, release, written
from .components import connected_components
from .wordhash import Words, mixed, row_grams, text_slices

N = 5
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Similarity NUM / DEN.
NUM, DEN = 3, 4
#: Shares of the documents from which a shingle is left out, tier by tier (0: seen in
#: three different sets of one chunk); the last tier leaves out nothing. LISTED bounds
#: each list that is sent to the tasks (any subset of the common shingles gives the
#: same links).
SHARES = (0.0, 0.002, 0.02)
LISTED = 1_000_000
CHUNK_DOCS = 8192
#: Keys that a task combines at once, and keys that come together in one place.
CHUNK_KEYS, PLACE_KEYS = 500_000, 500_000
#: Least and most bits of the number of places.
LEAST_BITS, MOST_BITS = 6, 18
#: A size band reaches from 4**k to 4**(k+1); 2.4 * 4**k blocks serve all its sizes.
BAND = 4
BLOCKS = 2.4
#: Open classes up to which a component's members are paired with those of another.
SMALL = 4
#: Partners by rare shingles meet in classes of size, FINE or more to each doubling.
FINE = 16
#: Ids up to which a list of documents to read again is sent to all executors.
BROADCAST_IDS = 1_000_000


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, sorted distinct shingles) of each row of a text column."""
    for batch in batches:
        for first, raw, offsets in text_slices(batch.column("text")):
            words = Words(raw, offsets, lower=True)
            grams = words.grams(N)
            for r in range(len(offsets) - 1):
                yield batch, first + r, np.unique(row_grams(words, grams, N, r))


def _class_of(s: np.ndarray) -> np.ndarray:
    """The id of a set's class, as an array of one."""
    total = mixed(s, 61).sum(dtype=np.uint64, keepdims=True)
    return mixed(total ^ mixed(np.bitwise_xor.reduce(mixed(s, 62), keepdims=True) + np.uint64(len(s)), 63), 61).view(np.int64)


class _Common:
    """Shingles that a share of the sets of a chunk holds. A shingle held by that share
    of all sets is held by it in one chunk at least. Copies count once."""

    def __init__(self, least_share: float) -> None:
        self.share, self.sets, self.size = least_share, {}, 0

    def add(self, c: int, s: np.ndarray) -> bool:
        """Whether the chunk is full."""
        if c not in self.sets:
            self.sets[c] = s
            self.size += len(s)
        return len(self.sets) >= CHUNK_DOCS or self.size > 1_000_000

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.unique(np.concatenate(list(self.sets.values())), return_counts=True)
        keep = n >= max(3, self.share * len(self.sets))
        self.sets, self.size = {}, 0
        return h[keep].view(np.int64), n[keep]


def common_shingles(heavy: DataFrame, total: int, shares: tuple[float, ...] = SHARES) -> list[np.ndarray]:
    """One sorted array per share, of ``heavy`` (h, times) over ``total`` rows. Its size is
    bounded: at most (mean set size / share) shingles can be so common, and LISTED holds
    in any case."""
    counts = written(heavy.groupBy("h").agg(F.sum("times").alias("times")), "heavy-shingles")
    out = []
    for share in shares:
        top = counts.filter(F.col("times") >= max(3, share * total)).orderBy(F.desc("times"), "h").limit(LISTED).select("h")
        out.append(np.sort(top.toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64)))
    release(counts)
    return out


def _without(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common) or not len(s):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[common[at] != s]


def _schemes(n: int) -> list[tuple[int, int]]:
    """(band, most shingles in which a partner met in that band can differ): the own
    band, as the smaller or an equal; the band below, as the larger."""
    band = 0
    while BAND ** (band + 1) <= n:
        band += 1
    out = [(band, (n + n * DEN // NUM) // 7)]
    if band and n * NUM <= DEN * (BAND**band - 1):
        out.append((band - 1, (n + BAND**band - 1) // 7))
    return out


def _slack(most: int) -> int:
    """Blocks emitted beyond ``most``."""
    return 1 + most // 4


def _need(n: int) -> int:
    """Keys that a set of ``n`` shingles shares with any similar one. Similar sets differ
    in no more blocks than either allows for (``most``), so that the first most + slack
    non-empty blocks of one of them hold slack blocks or more in which both agree, and
    these are among the first of the other. The least partner, of 3/4 n shingles, has
    the least slack."""
    return _slack(((NUM * n + DEN - 1) // DEN + n) // 7)


def _block_keys(s: np.ndarray, band: int, tier: int, most: int) -> tuple[np.ndarray, int]:
    """Keys of the first most + slack non-empty blocks, and how many are non-empty."""
    if not len(s):
        return s, 0
    blocks = np.uint64(int(BLOCKS * BAND**band) + 2)
    place = ((mixed(s, 3 + band) >> np.uint64(32)) * blocks) >> np.uint64(32)
    order = np.argsort(place, kind="stable")
    place = place[order]
    heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    values = np.bitwise_xor.reduceat(s[order], heads)[: most + _slack(most)]
    keys = mixed(values ^ mixed(place[heads[: len(values)]] * np.uint64(64) + np.uint64(band), 40 + tier), 50 + tier)
    return keys, len(heads)


def _prefix_keys(s: np.ndarray, band: int) -> np.ndarray:
    """Keys of the first shingles, one of which every similar set has among its own
    first ones, as it shares NUM / DEN of the larger set at least."""
    return mixed(s[: len(s) - (NUM * len(s) + DEN - 1) // DEN + 1] + np.uint64(band), 55)


#: A key on its way: 29 bits beside those of its place, and what it says of its class: met
#: in the band below its own; few blocks, so that one shared key is enough; stands for
#: classes of the same task.
_BELOW, _FEW, _LEADS = 1, 2, 4


def _keys(commons: list[np.ndarray], bits: int):
    tiers = [*commons, np.zeros(0, dtype=np.uint64)]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def of(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Keys of a set, with flags."""
        for below, (band, most) in enumerate(_schemes(len(s))):
            found = []
            for t, common in enumerate(tiers):
                k, n = _block_keys(_without(s, common), band, t, most)
                found.append(k)
                if n >= most + _slack(most):
                    break
            else:
                if n <= most:
                    found.append(_prefix_keys(s, band))
                below |= _FEW
            yield np.concatenate(found), below

    def combined(chunk: int, keys: np.ndarray, cs: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        """A row for each place with the keys that come together there, and one for each
        with those known to be shared, which go anywhere."""
        order = np.lexsort((cs, keys))
        keys, cs, flags = keys[order], cs[order], flags[order]
        head = np.concatenate(([True], keys[1:] != keys[:-1]))
        more = np.concatenate((~head[1:], [False])) & head
        place = (keys >> np.uint64(64 - bits)).astype(np.int64)
        rest = ((keys << np.uint64(bits)) >> np.uint64(35)).astype(np.uint32) << np.uint32(3)
        rest |= (flags + _LEADS * more).astype(np.uint32)
        out: list[list] = [[], [], [], []]
        for mask, known in ((head, 0), (~head, 1)):
            p, r, c = place[mask], rest[mask], cs[mask]
            cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, dtype=np.int64)
            for a, b in zip(cut.tolist(), [*cut.tolist(), len(p)][1:], strict=True):
                at = int(p[a])
                slot = (1 << bits) + (at * 31 + chunk) % (1 << bits) if known else at
                for col, v in zip(out, (slot, at, r[a:b].tobytes(), c[a:b].tobytes()), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["slot", "place", "keys", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cs, flags, held, seen, chunk = [], [], [], 0, set(), 0
        for batch, row, s in _sets(batches):
            if not len(s) or not batch.column("doc_id")[row].is_valid:
                continue
            c = _class_of(s)
            if int(c[0]) in seen:
                continue
            seen.add(int(c[0]))
            chunk = chunk or int(c[0]) & 0xFFFF
            for k, flag in of(s):
                keys.append(k)
                cs.append(np.full(len(k), c[0]))
                flags.append(np.full(len(k), flag, dtype=np.uint8))
                held += len(k)
            if held > CHUNK_KEYS:
                yield combined(chunk, np.concatenate(keys), np.concatenate(cs), np.concatenate(flags))
                keys, cs, flags, held, seen, chunk = [], [], [], 0, set(), 0
        if keys:
            yield combined(chunk, np.concatenate(keys), np.concatenate(cs), np.concatenate(flags))

    return run


def _shared(bits: int):
    """What has come together in a slot -> (key, c, below, few) of the shared keys."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rest, cs, places = [], [], []
        for place, k, c in zip(table.column("place").to_pylist(), table.column("keys"), table.column("classes"), strict=True):
            rest.append(np.frombuffer(k.as_buffer(), dtype=np.uint32))
            cs.append(np.frombuffer(c.as_buffer(), dtype=np.int64))
            places.append(np.full(len(rest[-1]), place, dtype=np.int64))
        rest, cs = np.concatenate(rest), np.concatenate(cs)
        keys = (np.concatenate(places) << 29) | (rest >> np.uint32(3)).astype(np.int64)
        if key[0].as_py() < 1 << bits:
            order = np.lexsort((cs, keys))
            rest, cs, keys = rest[order], cs[order], keys[order]
            head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(head, len(keys)))
            several = (cs[head] != cs[head + size - 1]) | (np.bitwise_or.reduceat(rest, head) & _LEADS > 0)
            keep = np.repeat(several, size)
            rest, cs, keys = rest[keep], cs[keep], keys[keep]
        return pa.table({"key": keys, "c": cs, "below": (rest & _BELOW > 0), "few": (rest & _FEW > 0)})

    return run


def _sketch(s: np.ndarray, band: int) -> bytes:
    """One-hot parity sketch of BAND**(band + 1) bits (64 at least): about as many bits
    as the largest set of the band has shingles, so that long documents don't fill it."""
    bits = max(64, BAND ** (band + 1))
    place = ((mixed(s, 60) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


#: What ``_signatures`` yields.
SIGNATURE = "doc_id long, n long, c long, band int, own binary, below binary, need int, h long, times long"


def _signatures(least_share: float):
    """doc_id, n, the set's class c, its band, its sketches for that band and, where it has
    partners there, for the band below, and the keys that it shares with similar sets;
    beside these, rows of h and times for the common shingles of each chunk."""
    names = ["doc_id", "n", "c", "band", "own", "below", "need", "h", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def rows(cols: list[list]) -> pa.RecordBatch:
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)] + [pa.nulls(n, k) for k in kinds[7:]], names=names)

    def counts(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(h), k) for k in kinds[:7]] + [pa.array(h), pa.array(n.astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in names[:7]]
        chunk = _Common(least_share)
        for batch, row, s in _sets(batches):
            c, bands = int(_class_of(s)[0]), [band for band, _ in _schemes(len(s))]
            values = (
                batch.column("doc_id")[row].as_py(), len(s), c, bands[0],
                _sketch(s, bands[0]), _sketch(s, bands[1]) if len(bands) > 1 else None, _need(len(s)),
            )
            for col, v in zip(cols, values, strict=True):
                col.append(v)
            if len(cols[0]) >= 1024:
                yield rows(cols)
                cols = [[] for _ in cols]
            if chunk.add(c, s):
                yield counts(*chunk.taken())
        if cols[0]:
            yield rows(cols)
        if chunk.sets:
            yield counts(*chunk.taken())

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes, bands and sketches -> (u, v) of those within the Hamming bound."""
    for batch in batches:
        keep = []
        cols = (batch.column(c).to_pylist() for c in ("nu", "nv", "bu", "bv", "ou", "ov", "lu", "lv"))
        for nu, nv, bu, bv, ou, ov, lu, lv in zip(*cols, strict=True):
            x, y = (ou, ov) if bu == bv else (lu, ov) if bu == bv + 1 else (ou, lv) if bv == bu + 1 else (None, None)
            far = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() if x is not None and y is not None else nu + nv
            keep.append(7 * far <= nu + nv)
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, su, sv: shingles as bytes) -> those of similarity NUM / DEN or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("su"), batch.column("sv"), strict=True):
            a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(a) + len(b) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each row as bytes, under its class."""
    ids, sets = [], []
    for _, _, s in _sets(batches):
        ids.append(int(_class_of(s)[0]))
        sets.append(s.tobytes())
        if len(ids) >= 512:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "s"])
            ids, sets = [], []
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "s"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each row's set, under its class."""
    names, held, cols = ["id", "n", "h"], 0, [[], [], []]
    for _, _, s in _sets(batches):
        for c, v in zip(cols, (np.repeat(_class_of(s), len(s)), np.full(len(s), len(s)), s.view(np.int64)), strict=True):
            c.append(v.astype(np.int64))
        held += len(s)
        if held > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)
            held, cols = 0, [[], [], []]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)


def _texts_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class in ``ids`` (written, distinct), or a few where a
    doc_id repeats; the sets made of them are joined by class again."""
    reps = ids.join(nodes.select(F.col("c").alias("id"), "rep"), "id").select("rep")
    few = ids.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(reps) if few else reps, F.col("doc_id") == F.col("rep"), "left_semi")


def _merged(df: DataFrame, comps: DataFrame) -> DataFrame:
    """``df`` with the components (node, component) of its comp, where it has one."""
    return df.join(comps, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component")


def _hubs(links: DataFrame, *comps: DataFrame) -> DataFrame:
    """(comp, hub): the class with most links of each component."""
    ends = links.select(F.col("u").alias("id")).unionByName(links.select(F.col("v").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    ends = ends.withColumn("comp", F.col("id"))
    for c in comps:
        ends = _merged(ends, c)
    return ends.groupBy("comp").agg(F.max(F.struct("k", "id")).alias("x")).select("comp", F.col("x.id").alias("hub"))


def _rare_stars(docs: DataFrame, nodes: DataFrame, small: DataFrame, large: DataFrame) -> DataFrame:
    """Links of stars that take one document to each rare shingle and class of sizes.

    Edited copies of one text differ from it by d and e shingles, and from each other
    by d + e at most: whoever has kept most of the text is similar to far more of them
    than the others are. So the star's middle is the set with the least that is rare
    (``mass``: each shingle counts as one part in the number of sets that have it)."""
    lead = small.groupBy("size", "h").agg(F.min(F.struct("mass", "id", "comp")).alias("x"))
    stars = large.join(lead, ["size", "h"]).filter(F.col("comp") != F.col("x.comp"))
    stars = stars.select(F.least("id", "x.id").alias("u"), F.greatest("id", "x.id").alias("v")).distinct()
    stars = written(stars, "rare-stars")
    found = _links(docs, stars, nodes, "rare-star-links")
    release(stars)
    return found


def _rare_pairs(docs: DataFrame, nodes: DataFrame, placed: DataFrame, links: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, candidates (u, v)) among the classes of ``placed`` (id, comp): in different
    components, and with a common shingle within the first ones of both, rarest first.
    ``links`` are those that made the components ``comps`` (node, component).

    The larger of two sets, of n shingles, looks once for each class of sizes from 3/4
    n to n, with as many shingles as the least size of the class demands; the smaller is
    found in its own class, with as many as a partner of its own size demands. Only
    sets of different components are brought together: stars around one set of each
    shingle join components, then the components of a shingle meet, then their sets."""
    rows = _texts_of(docs, nodes, placed.select("id")).mapInArrow(_set_rows, "id long, n long, h long")
    rows = written(rows.join(F.broadcast(placed) if placed.count() <= BROADCAST_IDS else placed, "id"), "open-shingles")
    seen = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = (
        rows.join(seen, "h").groupBy("id", "n", "comp").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("hs"))
        .withColumn("own", F.col("n") - F.size("hs"))
    )
    # more shingles of its own than any partner could lack: out
    ranked = ranked.filter(f"{DEN} * own <= ({DEN - NUM}) * n")
    mass = F.col("own") + F.aggregate("hs", F.lit(0.0), lambda a, x: a + 1 / x["df"])
    ranked = written(ranked.select("id", "comp", "n", "own", mass.alias("mass"), F.transform("hs", lambda x: x["h"]).alias("hs")), "open-ranked")
    release(rows)

    # class of a size: its leading binary digits q and the number e of the others
    def first(length: str, q: str, e: str) -> DataFrame:
        most = F.expr(f"CAST(greatest({length} - own, 0) AS INT)")
        return ranked_at.select("id", "comp", "mass", F.expr(f"{e} * {4 * FINE} + {q}").alias("size"), F.explode(F.slice("hs", F.lit(1), most)).alias("h"))

    e = f"greatest(0, CAST(length(bin(n)) AS INT) - {FINE.bit_length()})"
    least = f"(({NUM} * n + {DEN - 1}) DIV {DEN})"
    ranked_at = ranked.withColumn("e", F.expr(e)).withColumn("q", F.expr("shiftright(n, e)"))
    small = first(f"n - ({2 * NUM} * n + {NUM + DEN - 1}) DIV {NUM + DEN} + 1", "q", "e")
    # a class begins at q * 2**e; sizes 3/4 n to n lie in two values of e at most
    ranked_at = (
        ranked_at.withColumn("e", F.explode(F.array_distinct(F.array("e", F.expr(f"{e.replace('(n)', least)}")))))
        .withColumn("q", F.explode(F.expr(f"sequence(shiftright({least}, e), least(shiftright(n, e), CAST({2 * FINE - 1} AS BIGINT)))")))
        .filter(f"e = 0 OR q >= {FINE}")
        .withColumn("m", F.expr(f"greatest(shiftleft(q, e), {least})"))
    )
    large = first(f"n - ({NUM} * (n + m) + {NUM + DEN - 1}) DIV {NUM + DEN} + 1", "q", "e")
    small, large = written(small, "rare-small"), written(large, "rare-large")
    stars = _rare_stars(docs, nodes, small, large)
    end = lambda x: placed.select(F.col("id").alias(x), F.col("comp").alias("c" + x))
    joined = stars.join(end("u"), "u").join(end("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = connected_components(joined)
    placed = written(_merged(placed, merged), "open-merged")
    now = F.broadcast(placed) if placed.count() <= BROADCAST_IDS else placed
    small, large = (df.drop("comp").join(now, "id") for df in (small, large))
    hubs = _hubs(links.unionByName(stars), comps, merged)
    sides = lambda df, c: df.select("size", "h", F.col("comp").alias(c)).distinct()
    meet = written(sides(small, "a").join(sides(large, "b"), ["size", "h"]).filter("a <> b"), "rare-meetings")
    a_side = small.select("size", "h", F.col("comp").alias("a"), F.col("id").alias("x"))
    b_side = large.select("size", "h", F.col("comp").alias("b"), F.col("id").alias("y"))
    # the larger of two components is met by its hub, unless both are small
    known = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > SMALL).join(hubs, "comp")
    known = written(known, "open-hubs")
    of = lambda c: known.select(F.col("comp").alias(c), F.struct("k", F.col("comp").alias("i"), "hub").alias(f"h{c}"))
    meet = meet.join(of("a"), "a", "left").join(of("b"), "b", "left")
    by_a = F.col("ha").isNotNull() & (F.col("hb").isNull() | (F.col("ha") > F.col("hb")))
    meet = written(meet.withColumn("by", F.when(by_a, "a").when(F.col("hb").isNotNull(), "b")), "known-meetings")
    pairs = meet.filter("by IS NULL").select("size", "h", "a", "b").join(a_side, ["size", "h", "a"]).join(b_side, ["size", "h", "b"])
    strangers = meet.filter("by = 'a'").join(b_side, ["size", "h", "b"]).select(F.col("a").alias("comp"), F.col("ha.hub").alias("hub"), F.col("y").alias("id"))
    strangers = strangers.unionByName(
        meet.filter("by = 'b'").join(a_side, ["size", "h", "a"]).select(F.col("b").alias("comp"), F.col("hb.hub").alias("hub"), F.col("x").alias("id"))
    )
    strangers = written(strangers.distinct(), "strangers")
    by_hub, more = _by_hub(docs, nodes, placed, known, strangers)
    pairs = pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).unionByName(more)
    pairs = written(pairs.distinct(), "rare-pairs")
    release(ranked, small, large, meet, known, strangers)
    return by_hub.unionByName(stars), pairs


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a set and that of the hub -> in what they differ, and whether they link."""
    names = ["hub", "id", "stranger", "n", "d", "linked", "hs"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for x, y in zip(batch.column("s"), batch.column("hub_s"), strict=True):
            a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            delta = np.setxor1d(a, b, assume_unique=True)
            both = (len(a) + len(b) - len(delta)) // 2
            for c, v in zip(cols, (len(a), len(delta), DEN * both >= NUM * (both + len(delta)), delta.view(np.int64)), strict=True):
                c.append(v)
        known = [batch.column(k) for k in names[:3]]
        yield pa.RecordBatch.from_arrays(known + [pa.array(c, k) for c, k in zip(cols, kinds[3:], strict=True)], names=names)


def _by_hub(docs: DataFrame, nodes: DataFrame, placed: DataFrame, known: DataFrame, strangers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links of strangers with hubs, candidates (u, v) of the other strangers and members).

    ``strangers`` (comp, hub, id) are to be compared with all members of comp. With 7 d -
    n for a set of n shingles that differs in d from the hub, two similar sets have at
    least half of the sum of theirs, by 7, in common (a similar pair differs in no more
    than (n + m) / 7). So each shows, rarest first, as many of the shingles that both
    sides have as may be missed, and one more."""
    ids = strangers.select("comp").distinct()
    members = placed.join(known.select("comp", "hub"), "comp").join(ids, "comp", "left_semi").filter("id <> hub")
    asked = members.select("hub", "id", F.lit(False).alias("stranger")).unionByName(strangers.select("hub", "id", F.lit(True).alias("stranger")))
    asked = written(asked, "asked")
    wanted = written(asked.select("id").unionByName(asked.select(F.col("hub").alias("id"))).distinct(), "asked-ids")
    sets = written(_texts_of(docs, nodes, wanted).mapInArrow(_set_bytes, "id long, s binary").dropDuplicates(["id"]), "asked-sets")
    j = asked.join(sets, "id").join(sets.select(F.col("id").alias("hub"), F.col("s").alias("hub_s")), "hub")
    deltas = written(j.mapInArrow(_deltas, "hub long, id long, stranger boolean, n long, d long, linked boolean, hs array<long>"), "deltas")
    links = written(deltas.filter("stranger AND linked").select(F.least("hub", "id").alias("u"), F.greatest("hub", "id").alias("v")), "hub-links")
    apart = deltas.filter("NOT (stranger AND linked)").withColumn("w", F.expr(f"{NUM + DEN} * d - n"))
    shown = apart.select("hub", "stranger", "id", "w", F.explode("hs").alias("h"))
    both = shown.groupBy("hub", "h").agg(F.count(F.lit(1)).alias("df"), F.min("stranger").alias("lo"), F.max("stranger").alias("hi")).filter("lo <> hi")
    ranked = shown.join(both.select("hub", "h", "df"), ["hub", "h"]).groupBy("hub", "stranger", "id", "w").agg(
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs")
    )
    low = apart.groupBy("hub").agg(F.min(F.when(F.col("stranger"), F.col("w"))).alias("low_s"), F.min(F.when(~F.col("stranger"), F.col("w"))).alias("low_m"))
    ranked = ranked.join(low, "hub")
    least = F.greatest(F.lit(1), F.ceil((F.col("w") + F.when(F.col("stranger"), F.col("low_m")).otherwise(F.col("low_s"))) / F.lit(2 * (NUM + DEN)))).cast("int")
    first = ranked.select("hub", "stranger", "id", F.explode(F.slice("hs", F.lit(1), F.greatest(F.size("hs") - least + 1, F.lit(0)))).alias("x"))
    first = written(first.select("hub", "stranger", "id", "x.h"), "delta-first")
    side = lambda s, c: first.filter(F.col("stranger") == s).select("hub", "h", F.col("id").alias(c))
    pairs = side(False, "x").join(side(True, "y"), ["hub", "h"]).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    pairs = written(pairs.distinct(), "delta-pairs")
    release(asked, wanted, sets, deltas, first)
    return links, pairs


def _links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Of the candidate pairs (u, v) of classes, the similar ones."""
    side = lambda x: nodes.select(
        F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("band").alias(f"b{x}"), F.col("own").alias(f"o{x}"), F.col("below").alias(f"l{x}")
    )
    sized = pairs.join(side("u"), "u").join(side("v"), "v").filter(
        (NUM * F.col("nu") <= DEN * F.col("nv")) & (NUM * F.col("nv") <= DEN * F.col("nu"))
    )
    near = written(sized.mapInArrow(_near, "u long, v long"), label + "-pairs")
    ids = written(near.select(F.col("u").alias("id")).unionByName(near.select(F.col("v").alias("id"))).distinct(), label + "-ids")
    sets = written(_texts_of(docs, nodes, ids).mapInArrow(_set_bytes, "id long, s binary"), label + "-sets")
    j = near.join(sets.select(F.col("id").alias("u"), F.col("s").alias("su")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v"
    )
    out = written(j.mapInArrow(_verify, "u long, v long").distinct(), label)
    release(near, ids, sets)
    return out


def shared_keys(docs: DataFrame, commons: list[np.ndarray], shingles: int) -> DataFrame:
    """(key, c, below, few) of every key that several classes have. ``shingles``: their
    number over all rows, from which the number of places follows."""
    bits = min(MOST_BITS, max(LEAST_BITS, (shingles // 2 // PLACE_KEYS).bit_length()))
    sent = docs.mapInArrow(_keys(commons, bits), "slot long, place int, keys binary, classes binary")
    return sent.groupBy("slot").applyInArrow(_shared(bits), "key long, c long, below boolean, few boolean").distinct()


def _classes(named: DataFrame) -> DataFrame:
    """Of the signatures with a doc_id and a set: one row for each class, of its smallest document."""
    least = named.groupBy("c").agg(F.min(F.struct("doc_id", "n", "band", "need", "own", "below")).alias("x"))
    return least.select("c", F.col("x.doc_id").alias("rep"), *[f"x.{k}" for k in ("n", "band", "need", "own", "below")])


def _small_batches(link):
    """Rows with whole sets go to Python some hundred at a time: ten thousand, Spark's own
    measure, of two sets of thousands of shingles each would be gigabytes. The setting is
    the session's while the links are made."""

    @wraps(link)
    def run(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        conf = docs.sparkSession.conf
        old = conf.get(BATCH_ROWS, None)
        conf.set(BATCH_ROWS, "512")
        try:
            return link(docs)
        finally:
            conf.unset(BATCH_ROWS) if old is None else conf.set(BATCH_ROWS, old)

    return run


@_small_batches
def link_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures, labels): doc_id, n, c per row of ``docs``; c, component_id for each
    class of a linked document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = written(docs.mapInArrow(_signatures(min(SHARES)), SIGNATURE), "signatures")
    sigs = both.filter("n IS NOT NULL")
    named = sigs.filter("doc_id IS NOT NULL AND n > 0")
    nodes = written(_classes(named), "classes")
    rows, shingles = sigs.agg(F.count(F.lit(1)), F.sum("n")).first()
    commons = common_shingles(both.filter("h IS NOT NULL").select("h", "times"), rows)
    keys = written(shared_keys(docs, commons, shingles or 0), "shared-keys")
    # classes that share as many keys as a similar pair does
    told = keys.groupBy("c", "below").agg(F.count(F.lit(1)).alias("told"), F.max("few").alias("few")).join(nodes.select("c", "need", "rep"), "c")
    able = told.filter("few OR told >= need").select("c", "below", "rep")
    old, keys = keys, written(keys.join(able, ["c", "below"]).select("key", F.col("c").alias("id"), "rep").distinct(), "able-keys")
    release(old)
    # stars around the class of each key that has the smallest document
    first = F.min(F.struct("rep", "id"))
    lead = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), first.alias("x")).filter("k > 1").select("key", F.col("x.id").alias("lead"))
    stars = keys.join(lead, "key").filter("id <> lead").select(F.least("lead", "id").alias("u"), F.greatest("lead", "id").alias("v")).distinct()
    stars = written(stars, "stars")
    links = _links(docs, stars, nodes, "star-links")
    comps = connected_components(links)

    # classes of keys that still hold several components
    placed = written(
        keys.join(comps, keys["id"] == comps["node"], "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "placed"
    )
    release(keys)
    parted = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"))
    still_open = placed.join(parted.filter("lo <> hi AND k > 2").select("key"), "key", "left_semi")
    found, rest = _rare_pairs(docs, nodes, written(still_open.select("id", "comp").distinct(), "open-classes"), links, comps)
    more = _links(docs, rest.join(stars, ["u", "v"], "left_anti"), nodes, "cross-links").unionByName(found)
    release(placed, stars, rest)
    # rows that repeat a doc_id with other texts join the components of all of them
    many = named.groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    same = named.join(many, "doc_id").select(F.col("lo").alias("u"), F.col("c").alias("v")).filter("u <> v")
    final = connected_components(links.unionByName(more).unionByName(same))
    member = final.unionByName(final.select(F.col("component").alias("node"), "component").distinct())
    member = member.join(nodes.select(F.col("c").alias("node"), "rep"), "node")
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    return sigs, written(member.join(least, "component").select(F.col("node").alias("c"), "component_id"), "labels")


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, n, component_id for every row of ``docs``."""
    sigs, labels = link_components(docs)
    l = labels.select(F.col("c").alias("l_c"), "component_id")
    copies = sigs.filter("doc_id IS NOT NULL AND n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    copies = copies.join(l, copies["c"] == l["l_c"], "left_anti").select(F.col("c").alias("l_c"), F.col("rep").alias("component_id"))
    groups = l.unionByName(copies)
    joined = sigs.join(groups, (F.col("c") == F.col("l_c")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def ngram_join_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return _labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest document of their group; rows linked
    with nothing and rows without doc_id stay."""
    gone = written(_labelled(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    rows = packed(docs, k_id=F.col("doc_id").cast("long"))
    return rows.join(gone, F.col("k_id") == F.col("gone"), "left_anti").select("doc.*")
