"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always
stay. Wider patterns propose more spans (kinds key, mail, number), on which three
labelers vote yes, no or abstain: the span's own form (regex), the word before it
(gazetteer) and the characters it stands between (context). The base spans vote
too. Expectation-maximisation over the counts of vote patterns estimates how far
each labeler is to be trusted; its posteriors train the final span classifier, a
naive Bayes model over span features, which decides on the proposed spans.

Only DataFrame functions run here: spans are found row by row by splitting at the
pattern and summing lengths, models are sums over bounded tables of patterns.

Defined results: a null text is an empty one and has no spans; rows that repeat a
document are each searched, also without ``doc_id``; without any proposed span the
models stay at their start; an empty table gives an empty result; extra columns are
ignored; a text's cost grows with its length and, beyond some ten thousand spans, a
little faster. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind -> (cheap test, pattern). A match can only begin where its run begins or the
#: last match ended; saying so keeps long runs linear.
BASE = {
    "email": ("@", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?:[0-9][ -]?){15}[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
PROPOSED = {
    "key": (r"[A-Za-z0-9_-]{24}", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"),
    "mail": (r"[\[(]at[\])]", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+"),
    "number": (r"[0-9][ ().0-9-]{6,}[0-9]", r"(?<![A-Za-z0-9.+])[0-9][ ().0-9-]{6,}[0-9](?![A-Za-z0-9])"),
}
#: The gazetteer: words that stand before personal data, and before numbers that are none,
#: in English, German, French and Spanish. The last word before a span is looked up.
TERMS = {
    1: (
        "account", "call", "card", "cell", "contact", "email", "e-mail", "fax", "iban", "id", "key", "mail", "mobile", "passport", "password",
        "passwd", "phone", "pin", "secret", "ssn", "tel", "telephone", "token", "visa", "mastercard", "whatsapp",
        "ausweis", "handy", "karte", "kennwort", "konto", "kontonummer", "mobil", "passwort", "schluessel", "telefon",
        "carte", "compte", "courriel", "portable", "passeport", "telecopie", "mdp",
        "clave", "correo", "cuenta", "movil", "pasaporte", "tarjeta", "telefono",
    ),
    -1: (
        "chapter", "commit", "doi", "fig", "figure", "isbn", "issn", "no", "page", "pages", "rfc", "section", "sha", "table", "total", "version", "vol", "year",
        "abbildung", "abschnitt", "jahr", "kapitel", "seite", "tabelle", "chapitre", "numero", "tableau", "capitulo", "pagina", "tabla",
    ),
}
#: Matches, or base spans, that are gone through together, so that a text's cost is far
#: from the square of their number.
BLOCK = 256
LABELERS = ("form", "words", "place")
ROUNDS = 15
PRIOR, START, LEAST, MOST = 0.5, 0.8, 0.55, 0.98


def _with_matches(t: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``t`` (doc_id, text) -> doc_id and, for each kind, an array<struct<a, b, m, before>> of
    the leftmost non-overlapping matches. What a step uses more than once is a column
    of the step before, so that nothing is computed for each element again."""
    text, none = F.col("text"), F.array().cast("array<struct<a:int,b:int,m:string,before:string>>")
    long = lambda x: F.char_length(x["s"]) + F.coalesce(F.char_length(x["m"]), F.lit(0))
    parts = {k: F.arrays_zip(F.split(text, p, -1).alias("s"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m")) for k, (_, p) in patterns.items()}
    t = t.select("doc_id", *[F.when(text.rlike(patterns[k][0]), x).alias(k) for k, x in parts.items()])
    t = t.select("doc_id", *[_blocks(F.col(k)).alias(k) for k in patterns])
    sums = lambda k: F.transform(k, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + long(x)))
    t = t.select("*", *[sums(k).alias(f"{k}_n") for k in patterns])
    upto = lambda n: F.transform(n, lambda _, i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda s, x: s + x))
    t = t.select("doc_id", *patterns, *[upto(f"{k}_n").alias(f"{k}_n") for k in patterns])

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.char_length(x["s"])
        b = a + F.coalesce(F.char_length(x["m"]), F.lit(0))
        here = F.struct(a.alias("a"), b.alias("b"), x["m"].alias("m"), F.substring(x["s"], -24, 24).alias("before"))
        return F.struct(b.alias("at"), F.when(x["m"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(here))).alias("out"))

    every = lambda k: F.flatten(
        F.zip_with(k, f"{k}_n", lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"]))
    )
    return t.select("doc_id", *[F.coalesce(every(k), none).alias(k) for k in patterns])


def _blocks(rows: Column) -> Column:
    last = F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * BLOCK + 1, F.lit(BLOCK)))


def _luhn(m: Column) -> Column:
    digits = F.reverse(F.regexp_replace(m, "[^0-9]", ""))
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i))
    )
    return total % 10 == 0


def _digits(m: Column) -> Column:
    return F.char_length(F.regexp_replace(m, "[^0-9]", ""))


_CHECK = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: F.when(_digits(m).between(16, 19), _luhn(m)).otherwise(False),
    "phone": lambda m: _digits(m).between(8, 15),
    "key": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
    "mail": lambda m: F.lit(True),
    "number": lambda m: _digits(m).between(9, 24),
}


def _votes(kind: str, x: Column) -> Column:
    """A span with the labelers' votes (1, -1, 0) and features."""
    m, before = x["m"], x["before"]
    form = {
        "key": F.when(m.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$") | m.rlike(r"^(?:sk|pk|gh[a-z]|xox[a-z]|AKIA)[_-]?"), 1).when(m.rlike(r"[_-].*[_-]"), -1),
        "mail": F.lit(1),
        # 16 digits that are no base card have failed its checksum
        "number": F.when(m.rlike(r"^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 1).otherwise(-1),
    }.get(kind, F.lit(1))
    term = F.regexp_extract(F.lower(before), r"([a-z][a-z-]*)[^a-z0-9]*$", 1)
    words = F.when(term.isin(*TERMS[1]), 1).when(term.isin(*TERMS[-1]), -1)
    place = F.when(before.rlike(r"[=:\"'<(]\s*$"), 1).when(before.rlike(r"[/#_$.,-]$"), -1)
    share = _digits(m) / F.char_length(m)
    return F.struct(
        F.lit(kind).alias("kind"), x["a"].alias("a"), x["b"].alias("b"),
        F.coalesce(form, F.lit(0)).alias("form"), F.coalesce(words, F.lit(0)).alias("words"), F.coalesce(place, F.lit(0)).alias("place"),
        F.least(F.floor(F.char_length(m) / 8).cast("int"), F.lit(7)).alias("length"), F.floor(share * 4).cast("int").alias("digits"),
    )


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and proposed: arrays of spans with votes and features."""
    t = _with_matches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), BASE | PROPOSED)
    of = lambda k: F.transform(F.filter(k, lambda x: _CHECK[k](x["m"])), lambda x: _votes(k, x))
    both = t.select("doc_id", F.concat(*[of(k) for k in BASE]).alias("base"), F.concat(*[of(k) for k in PROPOSED]).alias("wide"))
    # base spans by start, in blocks that are looked into only where they may touch
    ends = F.transform("base", lambda y: F.struct(y["a"].alias("a"), y["b"].alias("b")))
    blocks = F.transform(
        _blocks(F.sort_array(ends)),
        lambda block: F.struct(F.array_min(F.transform(block, lambda y: y["a"])).alias("a"), F.array_max(F.transform(block, lambda y: y["b"])).alias("b"), block.alias("of")),
    )
    both = both.select("doc_id", "base", "wide", F.when(F.size("wide") > 0, blocks).alias("blocks"))
    touch = lambda x, y: (x["a"] < y["b"]) & (y["a"] < x["b"])
    apart = lambda x: ~F.exists("blocks", lambda k: touch(x, k) & F.exists(k["of"], lambda y: touch(x, y)))
    # a second use of blocks keeps it a column; Spark would put its making into the lambda
    return both.select("doc_id", "base", F.when(F.size("blocks") > 0, F.filter("wide", apart)).otherwise(F.col("wide")).alias("proposed"))


FEATURES = ("kind", "length", "digits", *LABELERS)


class SpanModel:
    """Reliability of the labelers, and log odds per feature value of the classifier."""

    def __init__(self, prior: float, trust: dict[str, float], odds: dict[str, dict] | None = None, bias: float = 0.0) -> None:
        self.prior, self.trust, self.odds, self.bias = prior, trust, odds or {}, bias

    def posterior(self, of) -> Column:
        s = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, a in self.trust.items():
            s = s + of(k) * F.lit(math.log(a / (1 - a)))
        return 1 / (1 + F.exp(-s))

    def score(self, of) -> Column:
        s = F.lit(self.bias)
        for k, table in self.odds.items():
            c = F.lit(0.0)
            for value, w in table.items():
                c = F.when(of(k) == F.lit(value), F.lit(w)).otherwise(c)
            s = s + c
        return 1 / (1 + F.exp(-s))


def fit_span_model(spans: DataFrame, rounds: int = ROUNDS) -> SpanModel:
    """EM over the vote patterns of all spans, then the classifier from its posteriors."""
    flat = spans.select(F.explode(F.concat("base", "proposed")).alias("x")).select(*[F.col(f"x.{k}").alias(k) for k in FEATURES])
    table = written(flat.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")), "span-patterns").coalesce(1)
    model = SpanModel(PRIOR, dict.fromkeys(LABELERS, START))
    for _ in range(rounds):
        p = table.select("*", model.posterior(F.col).alias("p"))
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("yes")]
        for k in LABELERS:
            right = F.when(F.col(k) == 1, F.col("p")).when(F.col(k) == -1, 1 - F.col("p")).otherwise(0.0)
            sums += [F.sum(F.col("n") * right).alias(f"r_{k}"), F.sum(F.when(F.col(k) != 0, F.col("n"))).alias(f"v_{k}")]
        row = p.agg(*sums).first()
        if not row["n"]:
            return model
        clip = lambda x, a=LEAST, b=MOST: min(b, max(a, x))
        model = SpanModel(
            clip(row["yes"] / row["n"], 0.2, 0.9), {k: clip((row[f"r_{k}"] + 2 * START) / ((row[f"v_{k}"] or 0) + 2)) for k in LABELERS}
        )
    soft = table.select("*", (F.col("n") * model.posterior(F.col)).alias("yes")).withColumn("no", F.col("n") - F.col("yes"))
    all_yes, all_no = soft.agg(F.sum("yes"), F.sum("no")).first()
    odds = {}
    for k in FEATURES:
        rows = soft.groupBy(k).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # 8 values at most
        odds[k] = {r[k]: math.log((r["yes"] + 1) / (all_yes + len(rows))) - math.log((r["no"] + 1) / (all_no + len(rows))) for r in rows}
    return SpanModel(model.prior, model.trust, odds, math.log((all_yes + 1) / (all_no + 1)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spans = written(find_spans(docs.select("doc_id", "text")), "spans")
    model = fit_span_model(spans)
    added = F.filter("proposed", lambda x: model.score(lambda k: x[k]) >= 0.5) if model.odds else F.slice("proposed", 1, 0)
    rows = spans.select("doc_id", "base", F.concat("base", added).alias("all"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
