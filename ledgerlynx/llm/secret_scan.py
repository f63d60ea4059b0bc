"""Secret scans over every historical version of files, with a ledger of what was scanned."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlynx.llm.common import doc_field, written
from ledgerlynx.session import scratch_path

_SPAN = "struct<kind:string,start:int,end:int>"
#: Short hashes of digests, of which a list may be broadcast.
SHORT = 1 << 20
_LEDGER = f"blob binary, rules array<string>, findings array<{_SPAN}>"


@dataclass(frozen=True)
class Rule:
    """``least`` characters of ``group`` must match; ``needs``: strings of which a text
    must hold one for the pattern to match at all."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Patterns and lengths of the three base kinds. Case of the assign
# keywords is ignored for ASCII letters only.
BASE = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12, (":", "=")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0, ("PRIVATE KEY-----",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, ("eyJ",)),
    Rule("url_login", 1, r"\b[a-z][a-z0-9+.-]{0,30}://[^\s/:@]{1,200}:[^\s/:@]{4,200}@", 0, 0, ("://",)),
)
RULES = BASE + MORE

_HEX = bytes(88 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """Leftmost matches of each rule that do not overlap, those that are long enough."""
    out = []
    for rule in rules:
        if rule.needs and not any(n in text for n in rule.needs):
            continue
        pattern = rule.pattern
        if pattern == r"[0-9a-f]+":
            # the runs are maximal, so asking for the length in the pattern finds the same ones
            if b"X" * rule.least not in text.encode("utf-8", "replace").translate(_HEX):
                continue
            pattern = r"[0-9a-f]{%d,}" % rule.least
        for m in re.finditer(pattern, text):
            start, end = m.span(rule.group)
            if end - start >= rule.least:
                out.append((rule.kind, *m.span()))
    return out


def _blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compressed text of each blob that the task has not just sent already."""
    sent: set[bytes] = set()
    for batch in batches:
        new = []
        for i, blob in enumerate(batch["blob"]):
            if blob not in sent:
                if len(sent) >= 1 << 20:
                    sent.clear()
                sent.add(blob)
                new.append(i)
        if not new:
            continue
        part = batch.iloc[new]
        yield pd.DataFrame({"blob": part["blob"], "data": [
            zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in part["text"]]})


def _scanner(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out = {"blob": [], "rules": [], "findings": []}
            for blob, data, todo in zip(batch["blob"], batch["data"], batch["todo"]):
                if blob == last:
                    continue  # copies from other tasks stand next to each other
                last = blob
                text = zlib.decompress(data).decode("utf-8", "surrogatepass")
                found = find(text, tuple(by_name[n] for n in todo))
                out["blob"].append(blob)
                out["rules"].append(list(todo))
                out["findings"].append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            if out["blob"]:
                yield pd.DataFrame(out)
    return scan


def content_address(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def update_ledger(versions: DataFrame, ledger: str, text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger has not seen and append it; returns the whole ledger.

    ``versions`` are historical versions of any number of paths. A version's
    blob is named by its content. Only pairs of a blob and a rule version that
    no row of the table at the path ``ledger`` has are scanned, each blob once.
    Digests meet the ledger first. Of texts whose digest shares a short hash with none that is to be scanned
    (at most ``SHORT`` such hashes, whatever the data) nothing is compressed or sent; the
    others travel to the scan once, compressed and without the copies of a task.
    A commit is one append of one job: if it fails, the next run does its work.
    """
    spark = versions.sparkSession
    names = [r.name for r in rules]
    text = versions[f"`{text_col}`"]
    blobs = versions.select(content_address(text).alias("blob"), text.alias("text"))
    seen = _ledger(spark, ledger)
    all_rules = F.array(*[F.lit(n) for n in names])
    if seen.isEmpty():
        todo = blobs.mapInPandas(_blobs, "blob binary, data binary").withColumn("todo", all_rules)
    else:
        known = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        pending = blobs.select("blob").distinct().join(known, "blob", "left") \
            .withColumn("todo", F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>")))) \
            .where("size(todo) > 0").select("blob", "todo")
        pending = written(pending, "secret-pending")
        short = F.pmod(F.xxhash64("blob"), F.lit(SHORT)).alias("short")
        some = F.broadcast(pending.select(short).distinct())  # at most SHORT numbers
        unseen = blobs.withColumn("short", short).join(some, "short", "left_semi").drop("short")
        todo = unseen.mapInPandas(_blobs, "blob binary, data binary").join(pending, "blob")
    once = todo.repartition("blob").sortWithinPartitions("blob")
    once.mapInPandas(_scanner(rules), _LEDGER).write.mode("append").parquet(ledger)
    return _ledger(spark, ledger)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, made empty where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], _LEDGER).write.mode("overwrite").parquet(path)
    return spark.read.schema(_LEDGER).parquet(path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, text_col: str = "text",
                     rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of ``versions`` (without its text) with ``findings``, sorted by start and
    then in the order of ``rules``; an empty list where there are none. Only the current
    version of each rule counts. Other columns stay as they are, whatever their names, but one
    named ``findings``, which the result replaces."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = F.array(*[F.lit(r.name) for r in rules])
    # a ledger row holds the findings of the rule versions it names, a kind in one version
    kept = ledger.select("blob", F.filter("findings", lambda f: F.exists(
        F.array_intersect("rules", current), lambda n: F.substring_index(n, "@", 1) == f["kind"])).alias("f"))
    merged = kept.groupBy("blob").agg(F.flatten(F.collect_list("f")).alias("f"))
    order = F.array_sort(F.transform("f", lambda f: F.struct(
        f["start"].alias("start"), F.array_position(kinds, f["kind"]).alias("place"),
        f["end"].alias("end"), f["kind"].alias("kind"))))
    found = merged.where("size(f) > 0").select("blob", order.alias("findings"))
    carried = [c for c in versions.columns if c != text_col and c.lower() != "findings"]
    doc = F.struct(F.lit(True).alias("__row"), *[versions[f"`{c}`"].alias(c) for c in carried])
    rows = versions.select(doc.alias("doc"), content_address(versions[f"`{text_col}`"]).alias("blob"))
    out = rows.join(written(found, "secret-findings"), "blob", "left")
    return out.select(*[doc_field(c).alias(c) for c in carried], F.coalesce("findings", F.array().cast(
        "array<struct<start:int,place:bigint,end:int,kind:string>>")).alias("findings"))


def scan(versions: DataFrame, ledger: str | None = None, text_col: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every row of ``versions``, scanning only what ``ledger`` lacks.

    Null and empty texts have no findings; repeated rows each get theirs; an
    empty table gives no rows.
    """
    ledger = ledger or scratch_path(versions.sparkSession, "secret-ledger")
    return findings_by_path(versions, update_ledger(versions, ledger, text_col, rules), text_col, rules)


def span_text(findings: Column) -> Column:
    return F.concat_ws(",", F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])))
