"""Metric text and host probes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SAMPLE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\d+)?$"
_LABEL = r'[A-Za-z_][A-Za-z0-9_]*="(?:[^"\\]|\\.)*"'


def prometheus_samples(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name, labels map, value, and the other columns) of exposition text, a line a row; comments and non-finite values are left out.

    A line that is no sample, and labels that are broken or named twice, fail the query, as a scrape that cannot be
    read must not pass for an empty one.  In label values a backslash stands before itself, a quote, or n for a new line.
    """
    text = F.trim(F.col(line))
    own = lines.where((text != "") & ~text.startswith("#"))
    name = F.regexp_extract(text, _SAMPLE, 1)
    number = F.regexp_extract(text, _SAMPLE, 3)
    finite, endless = number.try_cast("double"), F.lower(number).isin("nan", "+inf", "-inf", "inf")
    broken = F.raise_error(F.concat(F.lit("not a metric sample: "), text)).cast("double")
    value = F.when(endless, None).when(finite.isNull(), broken).otherwise(finite)
    inside = F.regexp_extract(text, _SAMPLE, 2)
    pairs = F.regexp_extract_all(inside, F.lit(f"({_LABEL})"), 1)
    plain = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]+)=", 1), plain(F.regexp_extract(p, '(?s)="(.*)"$', 1))))
    names = F.transform(entries, lambda e: e["col1"])
    whole = inside.rlike(rf"^\s*(?:{_LABEL}\s*(?:,\s*{_LABEL}\s*)*,?\s*)?$") & (F.size(F.array_distinct(names)) == F.size(names))
    wrong = F.raise_error(F.concat(F.lit("not the labels of a metric: "), text)).cast("map<string,string>")
    labels = F.when(whole, F.map_from_entries(entries)).otherwise(wrong)
    others = [c for c in lines.columns if c != line]
    return own.select(*others, name.alias("name"), labels.alias("labels"), value.alias("value")).where("value IS NOT NULL")


def processes(lines: DataFrame, line: str = "value") -> DataFrame:
    """(pid, rss_mb, command) of ``ps -eo pid,rss,args`` lines; heads and broken lines are left out."""
    parts = [F.regexp_extract(line, r"^\s*(\d+)\s+(\d+)\s+(\S.*)$", k) for k in (1, 2, 3)]
    return lines.where(parts[0] != "").select(parts[0].cast("long").alias("pid"), (parts[1].cast("long") / 1024).alias("rss_mb"), parts[2].alias("command"))


def listening_ports(lines: DataFrame, line: str = "value") -> DataFrame:
    """(port, pid) of ``ss -ltnp`` lines."""
    port, pid = F.regexp_extract(line, r"^LISTEN\s+\d+\s+\d+\s+\S*:(\d+)\s", 1), F.regexp_extract(line, r"pid=(\d+)", 1)
    return lines.where((port != "") & (pid != "")).select(port.cast("long").alias("port"), pid.cast("long").alias("pid"))


def gpu_processes(lines: DataFrame, line: str = "value") -> DataFrame:
    """(pid, gpu_mb) of comma-separated GPU process lines ``pid, memory MiB``."""
    parts = [F.regexp_extract(line, r"^\s*(\d+)\s*,\s*(\d+)(?:\s*MiB)?", k) for k in (1, 2)]
    return lines.where(parts[0] != "").select(parts[0].cast("long").alias("pid"), parts[1].cast("double").alias("gpu_mb")).groupBy("pid").agg(F.sum("gpu_mb").alias("gpu_mb"))


def memory_info(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row of total_mb, available_mb, swap_used_mb from ``Key: n kB`` lines."""
    key, kb = F.regexp_extract(line, r"^(\w+):", 1), F.regexp_extract(line, r":\s+(\d+)", 1).try_cast("double") / 1024
    of = lambda k: F.max(F.when(key == k, kb))
    return lines.agg(of("MemTotal").alias("total_mb"), of("MemAvailable").alias("available_mb"), (of("SwapTotal") - of("SwapFree")).alias("swap_used_mb"))


def setting(settings: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Key/value settings as one row; a key that is missing takes its default."""
    return settings.agg(*[F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(v)).alias(k) for k, v in keys.items()])


def json_number(text: Column, path: str) -> Column:
    """A number at a JSON path if its text is digits only, else null; signs are no digits."""
    found = F.get_json_object(text, path)
    return F.when(found.rlike("^[0-9]+$"), found.try_cast("long"))
