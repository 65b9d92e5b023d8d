"""Language identification by Bayesian evidence fusion.

For a page, the posterior over languages multiplies four kinds of evidence:
 * text: a multinomial over hashed byte trigrams of the visible text, trained on labelled documents by summed counts
   (BUCKETS numbers per language, so the broadcast model is at most 32 MB), tempered so that a long text counts like
   `effective` trigrams, which are not independent. The MOST_LANGUAGES - 1 languages of the most documents have a model
   each; if there are more, all others are one class, named OTHERS, trained on all their documents;
 * the language that the markup declares, and a language code that begins the address's path, each through the
   probability of that declaration given a language, counted over all pages;
 * the host, through a prior that is smoothed hierarchically: all pages, then the address suffix, then the host.
Counts are soft (each page adds its text posterior) and come from grouped aggregations that combine before they shuffle;
a page's own share is taken out of its host's, its suffix's and its codes' counts before they speak on the page, so no
page confirms itself. A hot host, suffix or code is one row of the grouped side; where it meets its pages the join is
salted.

Defined results: null html is empty text; an empty text is no evidence; a null or odd url has the host and suffix "";
repeated rows are pages of their own; without labelled documents language is null and probability 0. An empty table
gives no row. Columns other than page_id, url, html are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import persisted, utf8

BUCKETS, MOST_LANGUAGES, SALTS = 1 << 15, 256, 16
OTHERS = "und"
UNSEEN = re.compile(rb"(script|style)\b")
CLOSERS = {name: re.compile(rb"</" + name + rb"\s*>") for name in (b"script", b"style")}
ENTITY = re.compile(rb"&[#\w]+;")


def buckets(text: bytes) -> np.ndarray:
    x = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(17)).astype(np.int64)


def visible(html: bytes) -> bytes:
    """The text outside of comments, scripts, styles, tags and entities, each of which becomes a space.

    One pass: a closer that is not found is not sought again, as none stands further on either.
    """
    low, out, at = html.lower(), [], 0
    absent: set[bytes] = set()
    while (start := html.find(b"<", at)) >= 0:
        out.append(html[at:start])
        end = -1
        if low.startswith(b"<!--", start) and b"-->" not in absent:
            end = html.find(b"-->", start + 4)
            end = end + 3 if end >= 0 else absent.add(b"-->") or -1
        elif (m := UNSEEN.match(low, start + 1)) and m[1] not in absent:
            closer = CLOSERS[m[1]].search(low, m.end())
            end = closer.end() if closer else absent.add(m[1]) or -1
        if end < 0 and b">" not in absent:
            end = html.find(b">", start)
            end = end + 1 if end >= 0 else absent.add(b">") or -1
        if end < 0:  # a bracket that nothing closes is text
            out.append(b"<")
            end = start + 1
        else:
            out.append(b" ")
        at = end
    out.append(html[at:])
    return ENTITY.sub(b" ", b"".join(out))


def labelled(documents: DataFrame) -> DataFrame:
    """documents: lang, text, of those with a lang; languages past the MOST_LANGUAGES - 1 of the most documents are OTHERS."""
    known = documents.filter("lang IS NOT NULL").select("lang", "text")
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(most) <= MOST_LANGUAGES:
        return known
    return known.withColumn("lang", F.when(F.col("lang").isin([r["lang"] for r in most[: MOST_LANGUAGES - 1]]), F.col("lang")).otherwise(F.lit(OTHERS)))


def trigram_counts(documents: DataFrame) -> DataFrame:
    """documents: lang, text. lang, bucket, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                own += np.bincount(buckets(text.as_py()), minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    return labelled(documents).select("lang", utf8().alias("text")).mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probability of each bucket in each)."""
    rows = trigram_counts(documents).collect()  # at most MOST_LANGUAGES * BUCKETS rows
    languages = sorted({r["lang"] for r in rows})
    counts = np.full((len(languages), BUCKETS), 0.5, np.float32)
    for r in rows:
        counts[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32) if languages else counts


def evidence(pages: DataFrame, languages: list[str], logs: np.ndarray, effective: int) -> DataFrame:
    """pages: page_id, url, html. uid, page_id, host, suffix, declared, hint, text (tempered log likelihoods), soft (text posterior)."""
    url = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    code = F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://[^/?#]*/([a-z]{2,3})(?:[\-_][a-z0-9]+)?(?:[/?#]|$)", 1)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    table = pages.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        for batch in batches:
            scores, soft = [], []
            for html in batch.column(batch.num_columns - 1):
                b = buckets(visible(html.as_py()))
                own = model[:, b].sum(1, dtype=np.float64) * min(1.0, effective / max(1, len(b)))
                scores.append(own - own.max())
                p = np.exp(scores[-1])
                soft.append(p / p.sum())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, kind), pa.array(soft, kind)], names=[*batch.schema.names[:-1], "text", "soft"])

    rows = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", host.alias("host"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), declared.alias("declared"), code.alias("hint"), utf8("html").alias("html"))
    return rows.mapInArrow(run, "uid bigint, page_id bigint, host string, suffix string, declared string, hint string, text array<double>, soft array<double>")


def soft_sums(rows: DataFrame, by: str, n: int, name: str) -> DataFrame:
    sums = F.array(*(F.sum(F.get("soft", F.lit(i))) for i in range(n)))
    return rows.groupBy(by).agg(sums.alias(name))


def languages_of(pages: DataFrame, documents: DataFrame, effective: int = 60, host_weight: float = 4.0, suffix_weight: float = 20.0, code_weight: float = 10.0) -> DataFrame:
    """page_id, language, probability, text_language, declared, hint, suffix, host."""
    languages, logs = text_model(documents)
    if not languages:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("language"), F.lit(0.0).alias("probability"), *(none.alias(c) for c in ("text_language", "declared", "hint", "suffix", "host")))
    n = len(languages)
    rows = persisted(evidence(pages, languages, logs, effective), "evidence")
    overall = rows.agg(*(F.coalesce(F.sum(F.get("soft", F.lit(i))), F.lit(0.0)) for i in range(n))).first()
    all_pages = sum(overall)

    def met(joined: DataFrame, by: str) -> DataFrame:
        """joined with `by`_sum, the soft counts of its value in column `by` over all pages; salted, as a value may be hot."""
        sums = soft_sums(rows, by, n, f"{by}_sum").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return joined.join(sums, [by, "salt"])

    joined = rows.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int"))
    for by in ("host", "suffix", "declared", "hint"):
        joined = met(joined, by)

    prior = np.array([(s + 1) / (all_pages + n) for s in overall])
    overall_of, own_code = np.array(overall), {name: i for i, name in enumerate(languages)}

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            array = lambda name: column[name].flatten().to_numpy().reshape(-1, n)  # noqa: B023, E731
            soft, text = array("soft"), array("text")
            others = lambda by: np.maximum(array(f"{by}_sum") - soft, 0.0)  # noqa: B023, E731
            smoothed = lambda counts, towards, weight: (counts + weight * towards) / (counts.sum(1, keepdims=True) + weight)
            logs = text + np.log(smoothed(others("host"), smoothed(others("suffix"), prior, suffix_weight), host_weight))
            for by in ("declared", "hint"):
                # P(code | language), smoothed towards a speaker who names their own language half of the time
                codes = column[by].to_pylist()
                own = np.full(soft.shape, 0.5 / (n + 1))
                for row, code in enumerate(codes):
                    if code in own_code:
                        own[row, own_code[code]] = 0.5
                given = np.log((others(by) + code_weight * own) / (np.maximum(overall_of - soft, 0.0) + code_weight))
                logs += np.where(np.array([[bool(code)] for code in codes]).reshape(-1, 1), given, 0.0)
            best = logs.argmax(1)
            probability = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            name = lambda at: pa.array([languages[i] for i in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [column["page_id"], name(best), pa.array(probability), name(text.argmax(1)), *(column[c] for c in ("declared", "hint", "suffix", "host"))],
                names=["page_id", "language", "probability", "text_language", "declared", "hint", "suffix", "host"],
            )

    out = "page_id bigint, language string, probability double, text_language string, declared string, hint string, suffix string, host string"
    return joined.drop("salt", "uid").mapInArrow(fused, out)
