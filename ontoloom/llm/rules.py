"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good, votes bad, or abstains. Votes take few distinct patterns (at most 2 ** len(RULES), whatever
the corpus holds), so one aggregation counts them, expectation-maximisation over the counted patterns estimates
how often each rule votes on good and on bad documents and how common good ones are, and every pattern gets its posterior. The
posterior takes the place of an all-must-pass filter: a lone mistaken vote does not drop a document.

Defined results. A null text has no words. A text without words fails the base rules. Repeated rows and ties get
the same verdict. An empty table gives an empty table. Other columns pass through whatever their names are. Texts
count whole; three-word windows are compared by 64 bits of hash within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, shared_path

SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts", "n_stops")

#: name, vote (True: good), condition. A rule whose condition does not hold abstains.
RULES = (
    ("symbols", False, "n_symbols * 10 > n_words"),
    ("repeated windows", False, "n_repeat_words * 10 > n_words * 3"),
    ("capitals", False, "n_upper * 10 > n_letters * 4"),
    ("shouting", False, "n_shouts * 5 > n_words"),
    ("repeated lines", False, "n_lines >= 4 AND n_dup_lines * 2 > n_lines"),
    ("word length", False, "word_chars < n_words * 2 OR word_chars > n_words * 20"),
    ("plain prose", True, "n_symbols * 50 <= n_words AND n_repeat_words * 10 <= n_words AND n_upper * 5 <= n_letters AND n_shouts * 50 <= n_words"),
    ("mostly letters", True, "n_letters * 10 >= word_chars * 9 AND word_chars BETWEEN n_words * 3 AND n_words * 12"),
    ("sentences", True, "n_stops * 50 >= n_words AND n_stops * 2 <= n_words AND n_words >= 50"),
)
MIN_WORDS, MAX_REPEATED = 50, 50  # percent
PRIOR_DOCS = 4.0


def _stripped(text: Column, of: str) -> Column:
    return F.regexp_replace(text, of, "")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all of ``docs``) and FEATURES, as longs."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), body.alias("body"))
    # Step by step, so that each array is made once: an expression used more than once is not folded into its user.
    df = df.select(
        "row",
        F.filter(F.split("body", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        (F.length("body") - F.length(_stripped(F.col("body"), WORD))).cast("long").alias("word_chars"),
        F.length(_stripped(F.col("body"), r"[^#*$%&|<>]+")).cast("long").alias("n_symbols"),
        F.length(_stripped(F.col("body"), r"[^!?]+")).cast("long").alias("n_shouts"),
        F.length(_stripped(F.col("body"), r"[^.]+")).cast("long").alias("n_stops"),
        _stripped(F.col("body"), r"\P{L}+").alias("letters"),
    )
    df = df.select(
        "row", "word_chars", "n_symbols", "n_shouts", "n_stops",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("letters").cast("long").alias("n_letters"),
        F.length(_stripped(F.col("letters"), r"\P{Lu}+")).cast("long").alias("n_upper"),
        F.expr("IF(size(words) < 3, array(), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("windows"),
    )
    # The places of windows found twice or more, in order; each covers three words, less those the next one covers.
    places = """transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), s ->
        sort_array(transform(filter(transform(s, (x, k) -> IF(x.h = coalesce(get(s, k - 1).h, ~x.h) OR x.h = coalesce(get(s, k + 1).h, ~x.h), x.i, -1)), p -> p >= 0), p -> p)))[0]"""
    covered = f"transform(array({places}), p -> aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, b) -> a + b))[0]"
    df = df.withColumn("n_repeat_words", F.expr(f"IF(size(array_distinct(windows)) = size(windows), 0L, {covered})"))
    return df.select("row", *FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def votes() -> Column:
    """The rules that vote, as a bit each."""
    return sum((F.when(F.expr(f"({c})"), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, _, c) in enumerate(RULES)), F.lit(0)).cast("int")


def fit(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], list[tuple[float, float]], float]:
    """Votes' patterns with their counts to each one's posterior of good, for each rule how often it votes on good
    and on bad documents, and the share of good.

    Given the truth, rules vote or abstain independently. A rule votes at least as often on documents of the kind
    that it speaks for as on others (so the two kinds can't swap), and each rate is smoothed by a start value that
    counts as PRIOR_DOCS documents. Without documents the start values hold."""
    start = [(0.9, 0.3) if good else (0.05, 0.3) for _, good, _ in RULES]
    rate, share = list(start), 0.8

    def posterior(p: int) -> float:
        odds = math.log(share / (1 - share))
        for i, (t, f) in enumerate(rate):
            odds += math.log(t / f) if p >> i & 1 else math.log((1 - t) / (1 - f))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))

    patterns = sorted(counts)
    for _ in range(rounds if counts else 0):
        q = {p: posterior(p) for p in patterns}
        good = sum(counts[p] * q[p] for p in patterns)
        bad = sum(counts[p] * (1 - q[p]) for p in patterns)
        for i, (_, kind, _) in enumerate(RULES):
            t = (sum(counts[p] * q[p] for p in patterns if p >> i & 1) + PRIOR_DOCS * start[i][0]) / (good + PRIOR_DOCS)
            f = (sum(counts[p] * (1 - q[p]) for p in patterns if p >> i & 1) + PRIOR_DOCS * start[i][1]) / (bad + PRIOR_DOCS)
            if (t < f) == kind:
                t = f = (t + f) / 2
            rate[i] = (min(max(t, 1e-6), 1 - 1e-6), min(max(f, 1e-6), 1 - 1e-6))
        share = (good + 0.8 * PRIOR_DOCS) / (good + bad + PRIOR_DOCS)
    return {p: posterior(p) for p in counts}, rate, share


def judged(df: DataFrame) -> DataFrame:
    """Adds ``quality`` (posterior), ``base_failed`` and ``kept`` to what with_features() gives with ``votes``."""
    counts = {r["votes"]: r["count"] for r in df.where(~base_failed()).groupBy("votes").count().collect()}
    posteriors, _, _ = fit(counts)
    pairs = sorted(posteriors.items())  # at most 2 ** len(RULES)
    known = df.sparkSession.createDataFrame(pairs, "votes int, quality double")
    out = df.join(F.broadcast(known), "votes", "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= 0.5))


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, FEATURES, votes, quality, base_failed and kept of every row."""
    narrow = with_features(docs.select(id, text), text).select(F.col(f"row.`{id}`").alias(id), *FEATURES).withColumn("votes", votes())
    return judged(cut(narrow))


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep. They are written once with their votes, so texts are read twice
    but measured once."""
    spark = docs.sparkSession
    path = shared_path(spark, "rules")
    with_features(docs, text).withColumn("votes", votes()).write.parquet(path)
    return judged(spark.read.schema(_schema(docs)).parquet(path)).where("kept").select("row.*")


def _schema(docs: DataFrame):
    return docs.select(F.struct("*").alias("row"), *(F.lit(0).cast("long").alias(c) for c in FEATURES), F.lit(0).alias("votes")).schema
