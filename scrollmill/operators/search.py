"""Ranked substring search: exact BM25 over trigram lengths, rank, diversify."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.display import one_line


def tokens(query: str) -> list[str]:
    """Words of a query without outer punctuation, first of each in lower case."""
    return list(dict.fromkeys(t for w in query.lower().split() if (t := w.strip(".,;:!?()[]{}<>\"'`"))))


#: Particles and endings of Korean words.
KOREAN_ENDINGS = sorted((
    "은 는 이 가 을 를 에 의 도 로 와 과 지 다 요 에서 에게 으로 까지 부터 처럼 보다 이나 에는 라는 이라 에서는 으로는 이라는 "
    "하는 하고 하면 해서 했다 했지 했던 했고 한다 합니다 된다 되는 됐다 되어 했는데 하는데"
).split(), key=len, reverse=True)


def stem(word: str) -> str | None:
    """A Korean word without its longest ending, if two characters stay."""
    cut = next((e for e in KOREAN_ENDINGS if word.endswith(e) and len(word) - len(e) >= 2), None)
    return word[: -len(cut)] if cut else None


def forms_of(query: str) -> list[list[str]]:
    """For each word of a query the forms that count as a hit: itself, its stem."""
    return [list(dict.fromkeys(f for f in (w, stem(w)) if f)) for w in tokens(query)]


def occurrences(body: Column, form: str) -> Column:
    """Overlapping hits of a form."""
    return F.regexp_count(F.lower(body), F.lit(f"(?={re.escape(form)})"))


def bm25(rows: DataFrame, forms: list[str], body: str = "body") -> DataFrame:
    """Adds ``score`` (smaller is better) and ``matched``; rows without a hit go.

    Statistics are of all rows: one aggregation, whose single row is read first.
    """
    size = F.greatest(F.lit(0), F.length(body) - 2)
    hits = [F.lower(body).contains(f) for f in forms]
    stats = rows.agg(F.count("*").alias("n"), F.avg(size).alias("avg"), *(F.count_if(h).alias(f"n{i}") for i, h in enumerate(hits))).first()
    score = F.lit(0.0)
    for i, f in enumerate(forms):
        idf = F.greatest(F.lit(1e-6), F.log((F.lit(stats["n"]) - stats[f"n{i}"] + 0.5) / F.lit(stats[f"n{i}"] + 0.5)))
        freq = occurrences(F.col(body), f)
        score = score + F.when(hits[i], idf * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * size / F.lit(stats["avg"] or 1.0)))).otherwise(0.0)
    any_hit = reduce(lambda a, b: a | b, hits)
    matched = reduce(lambda a, b: a + b, (h.cast("int") for h in hits))
    return rows.where(any_hit).withColumn("score", -score).withColumn("matched", matched)


def rank(scored: DataFrame, n_forms: int) -> DataFrame:
    """Score weighted by the squared share of matched forms."""
    return scored.withColumn("ranked", F.col("score") * F.pow(F.col("matched") / n_forms, F.lit(2)))


def diversify(ranked: DataFrame, group: str, order: list, cap: int = 3, limit: int = 20) -> DataFrame:
    """The first ``cap`` rows of each group by rank, then the others, up to ``limit``."""
    nth = ranked.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return nth.orderBy((F.col("__n") > cap).cast("int"), *order).limit(limit).drop("__n")


def is_compact(kind: Column, body: Column) -> Column:
    """Compacted summaries are long and hit many words without being the answer."""
    return F.coalesce(kind.contains("compact"), F.lit(False)) | F.coalesce(body, F.lit("")).startswith("This session is being continued")


def search(rows: DataFrame, query: str, where: Column | None = None, limit: int = 20, pool: int = 3000, per_session: int = 3) -> DataFrame:
    """The rows (key, kind, ts, sid, body) that hold a word of ``query``, best
    first: key, kind, ts, sid, matched, ranked, snippet, at most ``limit``.

    Forms of three characters or more are scored over all rows and the ``pool``
    best are kept; rows that only hold shorter ones score 0. ``where`` filters
    after the statistics. The score is weakened by the squared share of matched
    words (one less for compacted summaries); ties by more matches, then the newest, then the
    key; ``per_session`` rows of a session come first, the others fill up.
    """
    words = forms_of(query)
    if not words:
        return rows.limit(0).select("key", "kind", "ts", "sid", F.lit(0).alias("matched"), F.lit(0.0).alias("ranked"), F.lit("").alias("snippet"))
    every = list(dict.fromkeys(f for fs in words for f in fs))
    long, short = [f for f in every if len(f) >= 3], [f for f in every if len(f) < 3]
    low, kept = F.lower(F.coalesce("body", F.lit(""))), F.lit(True) if where is None else where
    any_of = lambda fs: reduce(lambda a, b: a | b, (low.contains(f) for f in fs))
    parts = []
    if long:
        parts.append(bm25(rows, long).drop("matched").where(kept).orderBy("score", "key").limit(pool))
    if short:
        other = rows.where(any_of(short) & kept).withColumn("score", F.lit(0.0))
        parts.append(other.join(parts[0].select("key"), "key", "left_anti") if parts else other)
    found = reduce(lambda a, b: a.unionByName(b), parts)
    matched = reduce(lambda a, b: a + b, (any_of(fs).cast("int") for fs in words))
    share = F.greatest(F.lit(0), F.col("matched") - is_compact(F.col("kind"), F.col("body")).cast("int")) / len(words)
    ranked = found.withColumn("matched", matched).withColumn("ranked", F.round(F.col("score") * F.pow(share, F.lit(2)), 9)).withColumn("group", F.coalesce(F.col("sid").cast("string"), F.col("key").cast("string")))
    order = ["ranked", F.desc("matched"), F.desc_nulls_last("ts"), "key"]
    picked = diversify(ranked, "group", order, per_session, limit) if per_session else ranked.orderBy(*order).limit(limit)
    return picked.select("key", "kind", "ts", "sid", "matched", "ranked", excerpt(F.col("body"), every).alias("snippet"))


def excerpt(body: Column, forms: list[str], width: int = 70) -> Column:
    """The text around the first hit of the longest form that occurs, with marks
    where it is cut; without a hit the head of it."""
    low, whole = F.lower(body), F.coalesce(body, F.lit(""))
    at = F.coalesce(*(F.nullif(F.locate(f, low), F.lit(0)) for f in sorted(forms, key=len, reverse=True)))
    begin = F.greatest(F.lit(1), at - width)
    flat = F.trim(F.regexp_replace(F.substring(whole, begin, at + width - begin), r"(?U)\s+", " "))
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), flat, F.when(at + width - 1 < F.length(whole), "…").otherwise(""))
    return F.coalesce(cut, one_line(whole, 2 * width))


def snippet(body: Column, form: str, width: int = 70) -> Column:
    at = F.locate(form, F.lower(body))
    return F.when(at > 0, F.substring(body, F.greatest(F.lit(1), at - width), F.lit(2 * width + len(form))))
