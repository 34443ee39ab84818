"""Address filters: a sorted array of 64-bit digests, mapped into memory and probed by binary search."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.session import fresh_path

#: Rules that one mapped array holds at most (about 64 MB with their strings); more are joined instead.
MOST_RULES = 1_000_000
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), CAPITALS, SMALLS)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{path}".encode("utf-8", "surrogatepass"))


class DigestArray:
    """The rules of one file: digests in ascending order, and their strings at the same places.

    Layout: a header line of JSON, the digests, the ends of the strings, the
    strings.  Only the pages that a search touches are read.
    """

    def __init__(self, file: str):
        with open(file, "rb") as f:
            head = json.loads(f.readline())
            at = f.tell()
        n = head["n"]
        self.lengths = head["lengths"]  # of the paths, ascending
        self.digests = np.memmap(file, "<u8", "r", at, (n,)) if n else np.empty(0, "<u8")
        self.ends = np.memmap(file, "<i8", "r", at + 8 * n, (n + 1,)) if n else np.zeros(1, "<i8")
        self.text = np.memmap(file, "u1", "r", at + 16 * n + 8) if n else np.empty(0, "u1")

    @staticmethod
    def pack(rules: list[tuple[str, str, str]]) -> bytes:
        """(host, path, verdict) -> file content; of equal (host, path) the first verdict in order stays."""
        seen = {}
        for host, path, verdict in sorted(rules):
            seen.setdefault((host, path), verdict)
        rows = sorted((digest(h, p), f"{h}\n{p}\n{v}".encode("utf-8", "surrogatepass")) for (h, p), v in seen.items())
        head = json.dumps({"n": len(rows), "lengths": sorted({len(p) for _, p in seen})}).encode()
        head += b" " * (-(len(head) + 1) % 8) + b"\n"  # digests stay aligned
        keys = np.array([d for d, _ in rows], "<u8")
        ends = np.cumsum([0] + [len(s) for _, s in rows]).astype("<i8")
        return head + keys.tobytes() + ends.tobytes() + b"".join(s for _, s in rows)

    def confirm(self, at: int, key: int, host: str, path: str) -> str | None:
        """The verdict of the rule (host, path) among the entries with this digest; other strings with the same digest are passed over."""
        want = f"{host}\n{path}\n".encode("utf-8", "surrogatepass")
        while at < len(self.digests) and self.digests[at] == key:
            found = self.text[self.ends[at]:self.ends[at + 1]].tobytes()
            if found.startswith(want) and b"\n" not in found[len(want):]:
                return found[len(want):].decode("utf-8", "surrogatepass")
            at += 1
        return None

    def match(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """For each address the longest rule that fits, as host + path, and its verdict."""
        owner, names, starts = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            labels = host.split(".")
            cut = [path[:n] for n in self.lengths if n <= len(path)]
            for j in range(len(labels)):
                name = ".".join(labels[j:])
                for p in cut:
                    owner.append(i)
                    names.append(name)
                    starts.append(p)
        rule: list[str | None] = [None] * len(hosts)
        verdict: list[str | None] = [None] * len(hosts)
        if owner and len(self.digests):
            keys = np.fromiter((digest(h, p) for h, p in zip(names, starts)), "u8", len(names))
            at = np.searchsorted(self.digests, keys)
            hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == keys)
            for k in hit.tolist():
                i, found = owner[k], names[k] + starts[k]
                if rule[i] is None or len(found) > len(rule[i]):
                    said = self.confirm(int(at[k]), int(keys[k]), names[k], starts[k])
                    if said is not None:
                        rule[i], verdict[i] = found, said
        return rule, verdict


def publish(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Write the array to the shared folder and hand it to the executors; returns its name there."""
    name = f"digests-{uuid.uuid4().hex}"
    path = f"{fresh_path(spark, 'urls')}/{name}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(DigestArray.pack(rules)))
    out.close()
    spark.sparkContext.addFile(str(target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target)))
    return name


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    ``rules`` has (host, path, verdict).  A rule fits its host and all
    subdomains where the address's path starts with the rule's; the longest
    one wins, and where none fits the verdict is ``default``.  A null address,
    or one without ``://``, has an empty host and path.  Columns of the same
    names are replaced; repeated rows are judged alike; null rule fields count
    as empty.

    The number of rules is checked: up to ``most_rules`` they become one mapped
    digest array; beyond it addresses meet the rules in an equi-join on
    (host, path start), with the same result.
    """
    spark = pages.sparkSession
    clean = rules.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path", "verdict")]).distinct()
    given = clean.limit(most_rules + 1).collect()  # bounded by most_rules
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(*[F.col(f"`{c}`") for c in columns], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    if len(given) > most_rules:
        return _join_rules(base, columns, clean, default)
    name = publish(spark, [tuple(r) for r in given])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = DigestArray(SparkFiles.get(name))
        for batch in batches:
            rule, verdict = table.match(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            said = [v if v is not None else default for v in verdict]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(said, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    schema = StructType([*base.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return base.mapInArrow(probe, schema)


def _join_rules(base: DataFrame, columns: list[str], rules: DataFrame, default: str) -> DataFrame:
    """The same judgement by an equi-join: each distinct address offers its host suffixes, cut at the path lengths in use."""
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = rules.select(F.col("host").alias("_name"), F.length("path").alias("_length")).distinct()
    seen = base.select("host", "path").distinct().withColumn("_name", F.explode(names)).join(lengths, "_name").filter(F.col("_length") <= F.length("path"))
    offered = seen.withColumn("_start", F.substring(F.col("path"), F.lit(1), F.col("_length")))
    hits = offered.join(rules.select(F.col("host").alias("_name"), F.col("path").alias("_start"), "verdict"), ["_name", "_start"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("_name", "_start")).alias("n"), F.concat("_name", "_start").alias("rule"), "verdict")).alias("b"))
    return base.join(best, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in columns], "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
