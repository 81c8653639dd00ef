"""Predicates and filters: optional conjunctions, text matching, existence, policies, rules, sampling."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity by level name, most severe first.
LEVELS = ["error", "warn", "info", "debug", "trace"]


#: The least severe level that is stored of some targets and all below them; null: none is. Targets of one's own
#: instrumentation are added by the caller.
DENIED = {"hyper_util": "warn", "log": None, "rmcp::service": "info", "opentelemetry_sdk": "info"}


def ingested(target: Column, level: Column, denied: dict[str, str | None] = DENIED) -> Column:
    """Whether a log row is stored: of targets that are listed, or begin with a listed one, only rows as severe as it says."""
    out = F.lit(True)
    for name, least in sorted(denied.items(), key=lambda x: len(x[0])):  # the longest name that fits counts
        mine = F.startswith(target, F.lit(name))
        out = F.when(mine, at_least(level, least) if least else F.lit(False)).otherwise(out)
    return out


def both(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def either(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def optional(**options: object) -> Column:
    """Equality for scalars, membership for lists; None is no condition, an empty list lets nothing through."""
    preds = []
    for name, v in options.items():
        if v is None:
            continue
        preds.append(F.col(name).isin(*v) if isinstance(v, (list, tuple, set)) and v else F.lit(False) if isinstance(v, (list, tuple, set)) else F.col(name) == F.lit(v))
    return both(preds)


def at_least(level: Column, threshold: str) -> Column:
    """Levels as severe as the threshold or more."""
    return F.lower(level).isin(*LEVELS[: LEVELS.index(threshold.lower()) + 1])


def log_filter(
    df: DataFrame,
    *,
    kinds: list[str] | None = None,
    since: object = None,
    until: object = None,
    contains: dict[str, list[str]] | None = None,
    threads: list | None = None,
    threadless: bool = False,
    after: int | None = None,
    search: tuple[str, str] | None = None,
    newest: bool = True,
    limit: int | None = None,
    thread: str = "thread_id",
    kind: str = "kind",
    at: str = "ts",
    key: str = "id",
) -> DataFrame:
    """Log rows by any of: kind, time range, substrings by column, threads (and rows without one), cursor, body search."""
    preds = [optional(**{kind: kinds})]
    if since is not None:
        preds.append(F.col(at) >= F.lit(since))
    if until is not None:
        preds.append(F.col(at) <= F.lit(until))
    for column, needles in (contains or {}).items():
        preds.append(either(F.col(column).contains(n) for n in needles))
    if threads is not None:
        mine = F.col(thread).isin(*threads) if threads else F.lit(False)
        preds.append(mine | F.col(thread).isNull() if threadless else mine)
    if after is not None:
        preds.append(F.col(key) > after)
    if search:
        preds.append(contains_ci(F.col(search[0]), search[1]))
    out = df.where(both(preds)).orderBy(F.desc(key) if newest else F.asc(key))
    return out if limit is None else out.limit(limit)


def contains_ci(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def epoch(argument: Column) -> Column:
    """Unix seconds of a text that holds them or an RFC 3339 time; null if it is neither."""
    return F.coalesce(F.try_to_number(argument, F.lit("9999999999")).cast("long"), F.unix_timestamp(F.try_to_timestamp(argument)))


def exists(df: DataFrame, other: DataFrame, on: list[str], negate: bool = False) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti" if negate else "left_semi")


def by_policy(df: DataFrame, policy: DataFrame, on: list[str], keep: str = "keep") -> DataFrame:
    """Rows whose keys the policy table lets through; unknown keys are kept out."""
    return df.join(policy.where(keep).select(*on), on, "left_semi")


def rule_matches(df: DataFrame, rules: DataFrame, subject: str) -> DataFrame:
    """Each row with each rule of its kind whose regex finds the subject, a rule at most once a row. ``rules``: a
    table (rule_id, kind, pattern; null pattern: always), broadcast by Spark while it is small."""
    hit = F.col("pattern").isNull() | F.rlike(F.col(subject), F.col("pattern"))
    return df.join(rules.dropDuplicates(["rule_id"]), "kind").where(hit).drop("pattern")


def sample_keys(df: DataFrame, key: str, percent: int) -> DataFrame:
    """All rows of a fixed share of the keys, by the MD5 of the key as text, so other engines choose the same."""
    h = F.conv(F.substr(F.md5(F.col(key).cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return df.where(F.pmod(h, F.lit(100)) < percent)
