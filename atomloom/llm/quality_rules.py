"""Host-level quality rules: documents are judged with what is known of the host they come from.

Each document is measured and held against rules. Failures are summed by host, each host's
failure rate is shrunk towards the corpus with a beta prior fitted to the hosts themselves, and
the host's verdict goes back to its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import BROADCAST_ROWS, materialise, utf8, valid_text

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Softer rules, each a share of the words or lines of a document.
MAX_SYMBOL_PERCENT = 50
MAX_DUP_LINE_PERCENT = 50
MIN_MEAN_WORD, MAX_MEAN_WORD = 2.0, 20.0
#: Multiples of the corpus's odds of failure that a host's must surely exceed to be watched, and blocked, and the least rate of a blocked host.
WATCHED_TIMES, BLOCKED_TIMES, BLOCKED_RATE = 2.0, 5.0, 0.5
#: Standard deviations of a host's rate that count as sure.
SURE = 2.0
#: Host parts into which a hot host's documents are salted where the host table is not broadcast.
SALTS = 64

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one text; words are runs of anything but ASCII white space."""
    words = text.split()
    n_symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    # A code point is counted at the one byte that does not continue another.
    word_chars = len(b"".join(words).decode())
    lines = text.split(b"\n")
    n_dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                n_dup += bool(line.strip())
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = 0
    if len(set(windows)) < len(windows):
        counts, covered = Counter(windows), 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                n_repeat += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), word_chars, n_symbols, len(lines), n_dup, n_repeat


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(text) for text in utf8(batch.column("text"))]
        own = list(zip(*rows)) if rows else [()] * len(_MEASURES)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.record_batch([*(batch.column(n) for n in names), *(pa.array(x, pa.int64()) for x in own)], names=[*names, *_MEASURES])


def judge(docs: DataFrame, *, host: str = "source", watched_times: float = WATCHED_TIMES, blocked_times: float = BLOCKED_TIMES) -> DataFrame:
    """A verdict on every row of ``docs`` (doc_id, text, the ``host`` column; others are ignored).

    Base rules: at least 50 words, at most half of them in repeated three-word windows. Soft
    rules: symbols at most half as many as words, at most half of the lines repeated, mean word
    length within 2 to 20. A host's rate is the share of its documents that fail any rule, as
    the mean of a beta posterior: prior by the method of moments over all hosts. A host is
    watched whose rate lies, by two standard deviations of the posterior, above that of
    ``watched_times`` the odds of the prior's mean, and blocked where it lies so above that of
    ``blocked_times`` those odds and above a half. Documents that fail a base rule go. Of the others, a blocked host loses all, a watched one those that fail a
    soft rule, any other host those that fail two.

    Returns doc_id, the measures, base_failed, n_soft_failed, host_rate, host_verdict (open,
    watched or blocked) and kept. A null or empty text has no words and fails. Bytes that are no UTF-8
    count as U+FFFD. A null host is a host of its own. Repeated rows are judged alike, each for itself. An empty table gives an
    empty one. Hosts are summed on each task before the shuffle, so no host is gathered whole.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("\0none")).alias("host"), valid_text("text"))
    measured = rows.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{m} long" for m in _MEASURES))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    mean_word = F.try_divide("word_chars", "n_words")
    soft = [
        100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        F.coalesce((mean_word < MIN_MEAN_WORD) | (mean_word > MAX_MEAN_WORD), F.lit(False)),
    ]
    n_soft = sum((s.cast("int") for s in soft[1:]), soft[0].cast("int"))
    measured = materialise(measured.withColumns({"base_failed": base, "n_soft_failed": n_soft}), "quality")

    failed = (F.col("base_failed") | (F.col("n_soft_failed") > 0)).cast("int")
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed).alias("n_failed"))
    hosts = materialise(hosts, "hosts")
    # One row: the number of hosts, and the moments of their rates.
    rate = F.col("n_failed") / F.col("n")
    facts = hosts.agg(F.count("*").alias("hosts"), F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n")).alias("noise")).first()
    a, b = beta_prior(facts["mean"], facts["var"], facts["noise"])
    host_rate = (F.col("n_failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    surely = host_rate - SURE * F.sqrt(host_rate * (1 - host_rate) / (F.col("n") + F.lit(a + b + 1)))
    rate_at = lambda times: times * a / (b + times * a)
    verdict = F.when(surely > max(rate_at(blocked_times), BLOCKED_RATE), "blocked").when(surely > rate_at(watched_times), "watched").otherwise("open")
    verdicts = hosts.select("host", host_rate.alias("host_rate"), verdict.alias("host_verdict"))
    if facts["hosts"] <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(verdicts), "host")
    else:  # too many hosts to broadcast: a hot host's documents meet one of SALTS copies of its verdict
        salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"]).drop("salt")
    allowed = F.when(F.col("host_verdict") == "watched", 0).otherwise(1)
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "blocked") & (F.col("n_soft_failed") <= allowed)
    return joined.withColumn("kept", kept).drop("host")


def beta_prior(mean: float | None, var: float | None, noise: float | None) -> tuple[float, float]:
    """Beta(a, b) whose mean and variance are those of the hosts' rates, less the sampling noise.

    Without hosts, or where all rates agree, the uniform prior Beta(1, 1), or one as strong as
    1000 documents.
    """
    if mean is None:
        return 1.0, 1.0
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    spread = mean * (1 - mean)
    between = max((var or 0.0) - spread * (noise or 0.0), spread / 1001)
    strength = min(max(spread / between - 1, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 9).alias("host_rate"), "host_verdict",
    )


ORACLE = """
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents),
positions AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words),
windows AS (SELECT doc_id, i, row(w[i], w[i + 1], w[i + 2]) AS win FROM positions),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line FROM words),
dups AS (
  SELECT doc_id, sum(n - 1) AS n FROM (
    SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL)
  GROUP BY doc_id),
measured AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l) AS n_lines, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (100 * n_symbols > 50 * n_words)::INT + (100 * n_dup_lines > 50 * n_lines)::INT
         + coalesce(word_chars / nullif(n_words, 0)::DOUBLE NOT BETWEEN 2 AND 20, false)::INT AS n_soft
  FROM measured),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR n_soft > 0) AS n_failed FROM ruled GROUP BY host),
facts AS (SELECT avg(n_failed / n) AS m0, coalesce(var_samp(n_failed / n), 0) AS v, avg(1 / n) AS noise FROM hosts),
prior AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * noise, m * (1 - m) / 1001) - 1, 1), 1000) AS s
  FROM (SELECT *, least(greatest(m0, 0.001), 0.999) AS m FROM facts)),
rates AS (SELECT host, n + s + 1 AS seen, m, (n_failed + m * s) / (n + s) AS rate FROM hosts, prior),
verdicts AS (
  SELECT host, rate, CASE WHEN sure > greatest(5 * m / (1 + 4 * m), 0.5) THEN 'blocked' WHEN sure > 2 * m / (1 + m) THEN 'watched' ELSE 'open' END AS verdict
  FROM (SELECT *, rate - 2 * sqrt(rate * (1 - rate) / seen) AS sure FROM rates))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND verdict <> 'blocked' AND n_soft <= CASE WHEN verdict = 'watched' THEN 0 ELSE 1 END AS kept,
       round(rate, 9) AS host_rate, verdict AS host_verdict
FROM ruled JOIN verdicts USING (host)
"""
