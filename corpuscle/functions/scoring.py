"""Scores and plan rules on columns. Every "now" is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the plans.
PLAN_LIMITS = {
    "free": {"files": 50, "packs": 10, "storage_mb": 500, "file_mb": 100, "summaries": 50, "exports": 100, "refreshes": 0, "shares": 5, "queue": 10},
    "starter": {"files": 500, "packs": 50, "storage_mb": 10240, "file_mb": 200, "summaries": 1000, "exports": 3000, "refreshes": 100, "shares": 50, "queue": 50},
    "admin": {"files": 999999, "packs": 999999, "storage_mb": 999999, "file_mb": 999999, "summaries": 999999, "exports": 999999, "refreshes": 999999, "shares": 999999, "queue": 200},
}
#: File types by the class of their extraction.
FAST_TYPES = [
    "txt", "md", "csv", "png", "jpg", "jpeg", "webp", "heic", "heif", "gif", "bmp", "tiff", "tif", "py", "js", "ts", "jsx", "tsx", "css", "scss",
    "less", "sass", "xml", "yaml", "yml", "toml", "ini", "env", "conf", "cfg", "sh", "bash", "zsh", "bat", "ps1", "sql", "java", "kt", "swift", "c",
    "cpp", "h", "hpp", "cs", "go", "rs", "rb", "php", "log", "tsv", "vue", "svelte", "json", "html", "rtf",
]
DOC_TYPES = ["pdf", "docx", "xlsx", "pptx"]
#: Processors by file type: processor, fallback, cost in hundredths, types.
ROUTES = (
    ("local", None, 0, ["txt", "md", "csv", "log", "rst"]),
    ("local", None, 6, ["docx", "pptx", "xlsx"]),
    ("local", None, 0, ["html", "htm", "json", "rtf", "xml"]),
    ("local", None, 0, ["pdf"]),
    ("ai_ingest", "vault", 20, ["mp3", "wav", "m4a", "ogg", "flac", "aac", "wma"]),
    ("ai_ingest", "vault", 100, ["mp4", "mov", "webm", "mkv", "avi", "wmv", "flv"]),
    ("ai_ingest", "ocr", 2, ["jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "heic", "heif"]),
)


def age_days(moment, now) -> Column:
    """Whole days from ``moment`` to ``now``."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(moment)) / 86400)


def freshness(moment, now) -> Column:
    days = age_days(moment, now)
    return F.when(days <= 7, "current").when(days <= 30, "aging").otherwise("stale")


def recency(moment, now) -> Column:
    """15 up to a week, then falling to 0 at a year; 7.5 if unknown."""
    days = age_days(moment, now)
    return F.when(moment.isNull(), 7.5).when(days <= 7, 15.0).when(days >= 365, 0.0).otherwise(15.0 * (1 - (days - 7) / 358))


def importance(length, centrality, moment, now, source_of_truth, references) -> Column:
    """0 to 100 from length, centrality, recency, a flag and references; halves to the even number."""
    total = (
        F.when(F.coalesce(length, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(40.0), 10 * F.log10(F.greatest(length, F.lit(1)))))
        + 30 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), centrality))
        + recency(moment, now)
        + F.when(source_of_truth, 10.0).otherwise(0.0)
        + F.least(F.lit(5.0), 0.5 * F.greatest(references, F.lit(0)))
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total).cast("int")))


def importance_label(score) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def priority_class(ext) -> Column:
    return F.when(F.lower(ext).isin(FAST_TYPES), 1).when(F.lower(ext).isin(DOC_TYPES), 2).otherwise(3)


def route(ext) -> Column:
    """Struct of processor, fallback and cost of a file type; unknown ones go to the vault."""
    made = lambda p, f, c: F.struct(F.lit(p).alias("processor"), F.lit(f).cast("string").alias("fallback"), F.lit(c).alias("cost"))
    rule = F
    for processor, fallback, cost, types in ROUTES:
        rule = rule.when(ext.isin(types), made(processor, fallback, cost))
    return rule.otherwise(made("vault", None, 0))


def effective_plan(is_admin, status, period_end, now) -> Column:
    return F.when(is_admin, "admin").when(status.isin("starter_active", "starter_past_due"), "starter").when((status == "starter_canceled") & (period_end > now), "starter").otherwise("free")


def plan_limit(plan, what: str) -> Column:
    rule = F
    for name, limits in PLAN_LIMITS.items():
        rule = rule.when(plan == name, limits[what])
    return rule.otherwise(PLAN_LIMITS["free"][what])


def ewma(ordered, cap, start) -> Column:
    """Running average over an ordered array of durations: capped, 4/5 old and 1/5 new, rounded to cents at each step, negatives ignored."""
    return F.aggregate(ordered, start, lambda cur, d: F.when(d < 0, cur).otherwise(F.round(0.8 * cur + 0.2 * F.least(d, cap), 2)))


def backoff_seconds(attempt) -> Column:
    return F.least(F.lit(30.0), 2 * F.pow(F.lit(2.0), attempt))


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def type_code_valid(code) -> Column:
    """Whether a personality type has four letters of two choices each, and an identity, if any, of two."""
    return F.upper(code).rlike("^[EI][NS][FT][JP](-[AT])?$")


def fallback_score(query: str, filename, summary, topics, body, tags) -> Column:
    """What of a file matches: name .5, summary .4, a topic .3, body .3 where the summary doesn't, a tag .2; 1 at most, in thousandths."""
    q = F.lit(query.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    some = lambda a: F.coalesce(F.exists(a, lambda x: F.contains(F.lower(x), q)), F.lit(False))
    parts = ((has(filename), 0.5), (has(summary), 0.4), (some(topics), 0.3), (~has(summary) & has(body), 0.3), (some(tags), 0.2))
    total = sum((F.when(test, weight).otherwise(0.0) for test, weight in parts), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), total), 3)


def reduced_dimensions(n) -> tuple[Column, Column]:
    """Components and neighbours of a reduction of ``n`` vectors; null for under five, which aren't reduced."""
    return F.when(n >= 5, F.least(F.lit(30), F.greatest(F.lit(2), n - 2))), F.when(n >= 5, F.least(F.lit(15), n - 1))
