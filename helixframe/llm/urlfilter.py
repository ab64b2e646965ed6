"""URL filter: host and path rules, then a ratio of character Markov models.

Two variable-order Markov models over characters are counted from the URLs that
the rules accept and reject.  Each backs off from long to short contexts by
Witten-Bell smoothing; URLs without a rule are judged by the difference of
their log-likelihoods per character against a calibrated threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import discard, lower_ascii, store

#: (verdict, host, path), in the order of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 5
#: Follows the last character of each URL.
END = "\0"
#: Windows that a task holds at once.
RUN_CHARS = 1 << 17
BINS = 2001
RANGE = 8.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """Add host, path, ``rule`` and ``rule_verdict``; the longest fitting rule wins."""
    host, path = split_url(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return out.withColumns({"rule": name, "rule_verdict": verdict})


def _windows(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(..., url) -> (..., w): each character and the end mark, after up to ``order`` characters before it."""
    for batch in batches:
        keep = batch.schema.names[:-1]
        found: list[str] = []
        rows: list[tuple[int, int]] = []
        for row, url in enumerate([*batch.column("url").to_pylist(), None]):
            text = "" if url is None else url + END
            for start in range(0, len(text), RUN_CHARS):
                stop = min(start + RUN_CHARS, len(text))
                found += [text[max(i - order, 0) : i + 1] for i in range(start, stop)]
                rows.append((row, stop - start))
                if len(found) >= RUN_CHARS:
                    yield _window_batch(batch, keep, rows, found)
                    found, rows = [], []
        if found:
            yield _window_batch(batch, keep, rows, found)


def _window_batch(batch: pa.RecordBatch, keep: list[str], rows: list[tuple[int, int]], found: list[str]) -> pa.RecordBatch:
    of = np.repeat(*np.array(rows, np.int64).T)
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in keep), pa.array(found, pa.string())], [*keep, "w"])


def steps(urls: DataFrame, folds: int, order: int = ORDER) -> DataFrame:
    """(size, gram, a, b): chance of a gram's last character is a + b * that without the first character.

    ``urls`` is (fold, side, n, url), the side null where a URL counts in no
    model.  ``a`` and ``b`` have a pair of entries, accepted and rejected, for
    the model without each fold and at last for that of all URLs.  A gram of
    ``size`` characters has ``size`` - 1 of context; with n occurrences of the
    context and t characters seen after it, Witten-Bell smoothing gives
    a = count / (n + t) and b = t / (n + t), or 0 and 1 without the context.
    Grams shorter than their size begin a URL and step over.
    """
    parts = [(f, s, f"c{f}_{s}") for f in range(folds) for s in (0, 1)]
    cells = (F.sum(F.when((F.col("fold") == f) & (F.col("side") == s), F.col("n")).otherwise(0)).alias(c) for f, s, c in parts)
    whole = urls.mapInArrow(lambda b: _windows(b, order), "fold int, side int, n long, w string").groupBy("w").agg(*cells)
    sizes = F.explode(F.sequence(F.lit(1), F.lit(order + 1)))
    grams = whole.withColumn("size", sizes).withColumn("gram", F.right("w", F.col("size")))
    real = F.length("gram") == F.col("size")
    grams = grams.groupBy("size", "gram").agg(*(F.sum(F.when(real, F.col(c)).otherwise(0)).alias(c) for _, _, c in parts))
    # a context is followed by at most the alphabet
    context = Window.partitionBy("size", F.left("gram", F.col("size") - 1))
    models = [(f, s, f"m{f}_{s}") for f in range(folds + 1) for s in (0, 1)]
    grams = grams.select("size", "gram", *(sum((F.col(c) for g, t, c in parts if t == s and g != f), F.lit(0)).alias(m) for f, s, m in models))
    totals = {f"n_{m}": F.sum(m).over(context) for _, _, m in models}
    totals |= {f"t_{m}": F.sum((F.col(m) > 0).cast("long")).over(context) for _, _, m in models}
    grams = grams.select("*", *(c.alias(name) for name, c in totals.items()))
    held = lambda m: real & (F.col(f"n_{m}") > 0)
    all_of = lambda m: F.col(f"n_{m}") + F.col(f"t_{m}")
    a = F.array(*(F.when(held(m), F.col(m) / all_of(m)).otherwise(0.0) for _, _, m in models))
    b = F.array(*(F.when(held(m), F.col(f"t_{m}") / all_of(m)).otherwise(1.0) for _, _, m in models))
    return grams.select("size", "gram", a.alias("a"), b.alias("b"))


def ratios(nodes: DataFrame, folds: int, order: int = ORDER) -> DataFrame:
    """(w, ratio): log-ratio of the chances of each window's last character, in the models of :func:`steps`.

    Each size is joined with the one below on the gram without its first
    character, so a key meets at most one gram for each character before it.
    """
    level = None
    entries = range(2 * (folds + 1))
    for size in range(1, order + 2):
        at = nodes.filter(F.col("size") == size)
        if level is None:
            at = at.withColumn("p", F.array(*(F.lit(1.0 / 256) for _ in entries)))
        else:
            at = at.withColumn("tail", F.right("gram", F.lit(size - 1))).join(level.hint("merge"), F.col("tail") == F.col("w"))
        level = at.select(F.col("gram").alias("w"), F.array(*(F.col("a")[i] + F.col("b")[i] * F.col("p")[i] for i in entries)).alias("p"))
    return level.select("w", F.array(*(F.log(F.col("p")[i]) - F.log(F.col("p")[i + 1]) for i in entries[::2])).alias("ratio"))


def calibrate(scores: DataFrame) -> float:
    """Threshold with the least balanced error on held-out labelled scores (side, n, score).

    The scores are summed in ``BINS`` bins; without both classes it is 0.
    """
    bin_of = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
    got = scores.groupBy("side", bin_of.alias("bin")).agg(F.sum("n").alias("count")).toPandas()
    hist = np.zeros((2, BINS))
    hist[got["side"], got["bin"]] = got["count"]
    if not hist.sum(1).all():
        return 0.0
    share = hist / hist.sum(1, keepdims=True)
    # a threshold at the lower edge of bin b rejects what lies below it
    error = np.cumsum(np.insert(share[0], 0, 0)) + 1 - np.cumsum(np.insert(share[1], 0, 0))
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * RANGE - RANGE)


def judge(pages: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url", folds: int = 5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    The models count all URLs that a rule judges.  The threshold is calibrated
    on the same URLs, each scored by models without its fold, one of ``folds``
    (by hash of the URL).  The models give the verdict where no rule fits:
    ``allow`` at or above the threshold.  Without labelled URLs of both kinds
    the threshold is 0 and all scores are equal for the missing class, so the
    verdict stays defined.  A null URL scores as an empty one.  Rows are judged
    one by one, repeated rows alike; other columns are ignored.

    Counts are exact and stay in tables; only the bins of the calibration reach
    the driver.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_hf_url"))
    urls = with_rules(base.groupBy("_hf_url").agg(F.count(F.lit(1)).alias("n")), rules, "_hf_url")
    urls = urls.withColumn("side", (F.col("rule_verdict") == "block").cast("int")).withColumn("u", F.monotonically_increasing_id())
    urls = store(urls.withColumn("fold", F.pmod(F.xxhash64("_hf_url"), F.lit(folds)).cast("int")), "urls")
    nodes = store(steps(urls.select("fold", "side", "n", F.col("_hf_url").alias("url")), folds), "url-grams")
    chars = urls.select("u", "fold", F.col("_hf_url").alias("url")).mapInArrow(lambda b: _windows(b, ORDER), "u long, fold int, w string")
    each = chars.join(ratios(nodes, folds).hint("merge"), "w").select("u", F.get("ratio", F.col("fold")).alias("fit"), F.col("ratio")[folds].alias("all"))
    means = each.groupBy("u").agg(F.avg("fit").alias("fit"), F.avg("all").alias("all"))
    scored = store(urls.join(means.hint("merge"), "u"), "url-scores")
    discard(nodes)
    threshold = calibrate(scored.filter("side is not null").select("side", "n", F.col("fit").alias("score")))
    own = F.when(F.col("all") >= threshold, "allow").otherwise("block")
    verdicts = scored.select("_hf_url", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), F.col("all").alias("score"))
    return base.join(verdicts.hint("merge"), "_hf_url").drop("_hf_url")
