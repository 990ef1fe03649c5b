"""Prompts, model calls and merging of their results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import fence, file_of
from ..functions.text import STRICT, json_in
from .extract import snippets
from .ignore import last_of
from .packages import batches

# The prompts' wording.
SYSTEM = "You are a code analysis assistant. Analyze the following code elements and return a JSON array with summary and risks for each."
HEAD = "Analyze these code elements:"
TAIL = 'Return JSON array: [{"node_id": "...", "summary": "...", "risks": ["..."]}]'
ROLL_SYSTEM = "You are a code analysis assistant. Summarize the following child components into a single cohesive summary for the parent. Return JSON: [{\"node_id\": \"...\", \"summary\": \"...\"}]"

_LEDGER = "key string, response string, error string"


def pending(nodes: DataFrame) -> DataFrame:
    """Functions and classes that were never enriched."""
    return nodes.filter("type IN ('function', 'class') AND summary IS NULL")


def prompts(batched: DataFrame, with_code: bool = True) -> DataFrame:
    """(repo, batch, prompt) of nodes with batch, type, name, lines and, if wanted, code."""
    num = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    parts = [F.concat(F.lit("- type: "), num("type")), F.concat(F.lit("- name: "), num("name")), F.concat(F.lit("- lines: "), num("start_line"), F.lit("-"), num("end_line"))]
    if with_code:
        block = F.concat(F.lit("- code:\n```"), fence(file_of(F.col("node_id"))), F.lit("\n"), F.col("code"), F.lit("\n```"))
        parts.append(F.coalesce(block, F.lit("- code: (not available)")))
    body = F.concat_ws("\n", *parts, F.lit(""))
    g = batched.select("repo", "batch", "node_id", body.alias("body")).groupBy("repo", "batch").agg(F.sort_array(F.collect_list(F.struct("node_id", "body"))).alias("x"))
    items = F.transform("x", lambda x, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), x["node_id"], F.lit("\n"), x["body"]))
    return g.select("repo", "batch", F.concat_ws("\n", F.lit(HEAD + "\n"), F.array_join(items, "\n"), F.lit(TAIL)).alias("prompt"))


def answered(rows: DataFrame, send: Callable[[str, str], str], system: str = SYSTEM, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``rows`` (with prompt) with response and error: ``send(system, prompt)`` for each
    row, retried with doubled waits; a failing one leaves the others alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for prompt in frame["prompt"]:
                answer = error = None
                for k in range(tries):
                    try:
                        answer, error = send(system, prompt), None
                        break
                    except Exception as e:  # noqa: BLE001  a model may fail in any way
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**k if k + 1 < tries else 0)
                got.append((answer, error))
            yield frame.assign(response=[x[0] for x in got], error=[x[1] for x in got])

    schema = T.StructType([*rows.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    return rows.mapInPandas(run, schema)


def call_model(rows: DataFrame, send: Callable[[str, str], str], system: str = SYSTEM, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(repo, batch, response, error) of rows (repo, batch, prompt). Write the result before
    use, or use ``ask``, so that no retry of a later stage calls again."""
    return answered(rows.select("repo", "batch", "prompt"), send, system, tries, wait).drop("prompt")


def _prompt_key(system: str) -> Column:
    return F.sha2(F.concat(F.lit(system + "\0"), "prompt"), 256)


def ledger_answers(spark: SparkSession, ledger: str) -> DataFrame:
    """(key, response): what the model has said before, by the hash of what it was asked."""
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], "key string, response string")
    rows = spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    return rows.filter("response IS NOT NULL").groupBy("key").agg(F.min("response").alias("response"))


def ask(
    rows: DataFrame, send: Callable[[str, str], str], ledger: str, cut, system: str = SYSTEM,
    at_once: int = 8, per_round: int = 1000, tries: int = 3, wait: float = 1.0,
) -> DataFrame:
    """``rows`` (with prompt, not null) with response and error. Answers are kept in the
    folder ``ledger`` under a hash of system and prompt: what was answered once, in this
    run or another, isn't asked again, and equal prompts are asked once. ``at_once`` calls
    run at a time; after each round of about ``per_round`` calls the answers are written,
    so that a lost executor costs its own calls of one round. Failures aren't kept as
    answers: the next run asks these again."""
    spark = rows.sparkSession
    rows = rows.withColumn("key__", _prompt_key(system))
    told = ledger_answers(spark, ledger).withColumnRenamed("key", "key__")
    todo = cut(rows.select("key__", "prompt").dropDuplicates(["key__"]).join(told, "key__", "left_anti"))
    n = todo.count()
    rounds = max(1, -(-n // per_round))
    failed = []
    for k in range(rounds if n else 0):
        part = todo.filter(F.pmod(F.xxhash64("key__"), F.lit(rounds)) == k).repartition(at_once)
        path = f"{ledger.rstrip('/')}/{uuid.uuid4().hex}"
        answered(part, send, system, tries, wait).select(F.col("key__").alias("key"), "response", "error").write.parquet(path)
        failed.append(path)
    out = rows.join(ledger_answers(spark, ledger).withColumnRenamed("key", "key__"), "key__", "left")
    if failed:
        errors = spark.read.schema(_LEDGER).parquet(*failed).filter("response IS NULL").select(F.col("key").alias("key__"), "error")
        out = out.join(errors, "key__", "left")
    else:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out.drop("key__")


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejected batches). The whole answer as a JSON array, or if it isn't JSON
    its greedy ``[...]``; elements that aren't objects with a node_id are dropped."""
    many = "array<string>"
    inner = F.from_json(json_in(F.col("response"), "[", "]"), many, STRICT)
    whole = F.when(F.col("response").rlike(r"^\s*\["), F.from_json("response", many, STRICT))
    arr = F.when(F.try_parse_json("response").isNotNull(), whole).otherwise(inner)
    parsed = responses.withColumn("items__", arr)
    x = F.from_json("item", "node_id string, summary string, risks array<string>", STRICT)
    rows = parsed.select("repo", "batch", F.posexplode("items__").alias("pos", "item")).select("repo", "batch", "pos", x.alias("x"))
    ok = rows.filter("x.node_id IS NOT NULL").select("repo", "batch", "pos", "x.*")
    return ok, parsed.filter("items__ IS NULL").select(*responses.columns)


def merge_results(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes with the last result of their id; absent summary '' and risks []."""
    last = last_of(results, ["repo", "node_id"], [F.desc("batch"), F.desc("pos")]).select(
        "repo", "node_id", F.coalesce("summary", F.lit("")).alias("s__"), F.coalesce("risks", F.array().cast("array<string>")).alias("r__")
    )
    j = nodes.join(last, ["repo", "node_id"], "left")
    new = {"summary": F.coalesce("s__", "summary"), "risks": F.coalesce("r__", "risks")}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in nodes.columns])


def roll_up_prompts(parents: DataFrame) -> DataFrame:
    """``parents`` (repo, node_id, type, name, children: ordered (id, summary)) with prompt."""
    kids = F.array_join(F.transform("children", lambda x: F.concat(F.lit("- "), x["id"], F.lit(": "), x["summary"])), "\n")
    text = F.concat(F.lit("Summarize these components of "), F.coalesce("type", F.lit("unknown")), F.lit(" '"), F.coalesce("name", "node_id"), F.lit("':\n\n"), kids, F.lit("\n\nReturn summary for node_id: "), F.col("node_id"))
    return parents.withColumn("prompt", text)


def roll_up_answer(response, node_id):
    """The summary for ``node_id`` in a strictly JSON answer, else null."""
    rows = F.from_json(response, "array<struct<node_id:string,summary:string>>", STRICT)
    return F.get(F.filter(rows, lambda x: x["node_id"] == node_id), F.lit(0))["summary"]


def enrich_with_model(
    nodes: DataFrame, texts: DataFrame, send: Callable[[str, str], str], ledger: str, cut, batch_size: int = 10, **calls
) -> tuple[DataFrame, DataFrame]:
    """(nodes, failed batches): summaries and risks for the symbols that have none, asked
    for in batches with their code from ``texts`` (repo, path, text). ``calls`` goes to
    ``ask``."""
    todo = pending(nodes).withColumn("path", file_of(F.col("node_id")))
    batched = batches(cut(snippets(todo, texts)), batch_size, cut)
    said = cut(ask(prompts(batched), send, ledger, cut, SYSTEM, **calls))
    results, odd = parse_responses(said.filter("error IS NULL"))
    failed = said.filter("error IS NOT NULL").select("repo", "batch", "error").unionByName(odd.select("repo", "batch", F.lit("no JSON array").alias("error")))
    return merge_results(nodes, results), failed


def model_summaries(send: Callable[[str, str], str], ledger: str, cut, **calls) -> Callable[[DataFrame], DataFrame]:
    """For ``roll_up`` and ``roll_up_again``: one call for each parent, its answer if it is
    strict JSON that names the parent."""

    def answer(parents: DataFrame) -> DataFrame:
        said = ask(roll_up_prompts(parents), send, ledger, cut, ROLL_SYSTEM, **calls)
        return said.select("repo", "node_id", roll_up_answer(F.col("response"), F.col("node_id")).alias("summary"))

    return answer
