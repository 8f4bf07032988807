"""Features and models over a labelled corpus, with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agro_jobs.functions.text import bound, clean_text, tokens
from agro_jobs.operators import hashed, marks
from agro_jobs.sources.shared import shared, spread, written


def _pairs(words: F.Column) -> F.Column:
    """The words and all pairs of neighbours; every step is linear, whatever the text's length."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def _inside(said: F.Column) -> F.Column:
    """All runs of three to five letters of every word with a blank on either side; `said` has single blanks between words.

    Words are set two blanks apart, and a run may not hold both.
    """
    apart = F.concat(F.lit(" "), F.replace(said, F.lit(" "), F.lit("  ")), F.lit(" "))
    return F.concat(*[F.regexp_extract_all(apart, F.lit(rf"(?!.{{0,{n - 2}}}  )(?=(.{{{n}}}))"), F.lit(1)) for n in (3, 4, 5)])


def grams(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with words (one and two) and chars (three to five inside word boundaries)."""
    said = clean_text(F.col(text))
    return rows.withColumns({"words": bound(F.split(said, " "), _pairs), "chars": bound(said, _inside)})


#: Fixed value: bytes of a row group of counts. A reader holds up to 4,096 rows of a group unpacked, 8 bytes for each count: with groups of the usual size, hundreds of MB a task.
GROUP_BYTES = 1 << 20


def gram_counts(rows: DataFrame, features: int = 1 << 14, text: str = "text") -> DataFrame:
    """rows, but for their text, with n_words, n_chars (how many `grams`), tf_words and tf_chars: their counts as HashingTF makes them. Written once."""
    said = rows.select(*[c for c in rows.columns if c != text], F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" ")).alias("_said"))
    kept = T.StructType([f for f in said.schema if f.name != "_said"])

    def schema(vector: T.DataType) -> T.StructType:
        return T.StructType([*kept, T.StructField("n_words", T.IntegerType()), T.StructField("n_chars", T.IntegerType()), T.StructField("tf_words", vector), T.StructField("tf_chars", vector)])

    path = shared(rows.sparkSession, "grams")
    said.mapInArrow(lambda batches: hashed.gram_counts(batches, features), schema(VectorUDT.sqlType())).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return rows.sparkSession.read.schema(schema(VectorUDT())).parquet(path)


def tfidf(rows: DataFrame, features: int = 1 << 14) -> tuple[PipelineModel, DataFrame]:
    """A fitted TF-IDF of both kinds of grams (hashed, so no vocabulary reaches the driver) over their `gram_counts`, and those with features."""
    stages = [IDF(inputCol=f"tf_{c}", outputCol=f"idf_{c}", minDocFreq=2) for c in ("words", "chars")]
    stages.append(VectorAssembler(inputCols=["idf_words", "idf_chars"], outputCol="features"))
    ready = gram_counts(spread(rows), features)  # the texts are read once, every step of a fit reads their counts
    model = Pipeline(stages=stages).fit(ready)
    return model, model.transform(ready)


def terms(text: F.Column) -> F.Column:
    """ARRAY<STRUCT<kind, term>>: words of two letters or more and pairs of them, and three to five letters of every word with its blanks."""
    said = clean_text(F.coalesce(text, F.lit("")))
    words = bound(F.regexp_extract_all(said, F.lit("[a-z0-9]{2,}"), F.lit(0)), _pairs)
    chars = bound(said, _inside)

    def of(kind: str, found: F.Column) -> F.Column:
        return F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    return F.concat(of("word", words), of("char", chars))


def term_weights(rows: DataFrame, key: Sequence[str], text: str = "text", least: dict[str, int] | None = None) -> DataFrame:
    """key, kind, term, weight: tf times ln((1 + n) / (1 + df)) + 1, of length 1 for each row and kind. Character grams must be in two rows.

    Terms stay what they are (`tfidf` hashes them), so weights can be looked at and joined.
    """
    least = least or {"word": 1, "char": 2}
    n = rows.count()
    counted = spread(rows).select(*key, F.explode(terms(F.col(text))).alias("t")).groupBy(*key, "t.kind", "t.term").agg(F.count("*").alias("tf"))
    counted = written(counted, "terms")
    df = counted.groupBy("kind", "term").agg(F.count("*").alias("df")).where(F.coalesce(*[F.when(F.col("kind") == k, F.col("df") >= v) for k, v in least.items()]))
    raw = counted.join(df, ["kind", "term"]).withColumn("raw", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    size = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*key, "kind")))
    return raw.select(*key, "kind", "term", (F.col("raw") / size).alias("weight"))


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: classes count alike."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(n.join(F.broadcast(total))), label).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def head(train: DataFrame, label: str) -> PipelineModel:
    """A single-label classifier with balanced weights."""
    index = StringIndexer(inputCol=label, outputCol=f"{label}_index", handleInvalid="keep")
    lr = LogisticRegression(featuresCol="features", labelCol=f"{label}_index", weightCol="weight", maxIter=15, regParam=0.01, predictionCol=f"{label}_hat", probabilityCol=f"{label}_p", rawPredictionCol=f"{label}_raw")
    return Pipeline(stages=[index, lr]).fit(balanced(train, label))


def constrained(scored: DataFrame, no_data: Sequence[str], intent: str, slots: Sequence[str]) -> DataFrame:
    """Intents without data carry no slots; an activity only goes with advice."""
    empty = F.col(intent).isin(*no_data)
    out = scored.withColumns({s: F.when(~empty, F.col(s)) for s in slots})
    return out.withColumn("activity", F.when(F.col(intent) == "ADVICE", F.col("activity"))) if "activity" in scored.columns else out


def holdout(key: str, share: float = 0.15, seed: int = 13) -> F.Column:
    """Whether a row is held out: by a seeded hash of its key, so the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < int(share * 10_000)


def _without_summary(model: LogisticRegressionModel, spark: SparkSession) -> LogisticRegressionModel:
    """The model, saved and read again: its training summary would take the session along to the executors, which can't be sent once it observes anything."""
    path = shared(spark, "head")
    model.save(path)
    return LogisticRegressionModel.load(path)


def label_heads(train: DataFrame, labels: str, classes: Sequence[str], features: str = "features") -> dict[str, LogisticRegressionModel | float]:
    """A yes/no classifier for each class of an array column; a class that all rows or none have gets its share instead.

    Classes are a short fixed list; each fit is one Spark job over the rows.
    """
    shares = train.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains(labels, c)).alias(f"c{i}") for i, c in enumerate(classes)]).first()
    lr = LogisticRegression(featuresCol=features, labelCol="_y", maxIter=30, regParam=0.001)
    out: dict[str, LogisticRegressionModel | float] = {}
    for i, c in enumerate(classes):
        k = shares[f"c{i}"]
        out[c] = float(bool(k)) if k in (0, shares["n"]) else _without_summary(lr.fit(train.withColumn("_y", F.array_contains(labels, c).cast("double"))), train.sparkSession)
    return out


def label_scores(rows: DataFrame, heads: dict[str, LogisticRegressionModel | float], features: str = "features") -> DataFrame:
    """rows with scores: ARRAY<DOUBLE>, the probability of each class in the order of the heads."""
    out, parts = rows, []
    for i, head in enumerate(heads.values()):
        if isinstance(head, float):
            parts.append(F.lit(head))
            continue
        p = head.copy()
        p.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{i}").setFeaturesCol(features)
        out = p.transform(out)
        parts.append(F.get(vector_to_array(f"_p{i}"), F.lit(1)))
    return out.withColumn("scores", F.array(*parts)).drop(*[f"_p{i}" for i in range(len(heads))])


def chosen(scores: F.Column, classes: Sequence[str], cut: F.Column) -> F.Column:
    """The classes that reach the cut, the likeliest first; where none does, the likeliest alone (the first on ties)."""
    named = F.zip_with(scores, F.array(*map(F.lit, classes)), lambda p, c: F.struct((-p).alias("minus"), c.alias("label")))
    at = F.array_sort(F.transform(named, lambda x, i: F.struct(x["minus"].alias("minus"), i.alias("i"), x["label"].alias("label"))))
    over = F.filter(at, lambda x: -x["minus"] >= cut)
    return F.transform(F.when(F.size(over) > 0, over).otherwise(F.slice(at, 1, 1)), lambda x: x["label"])


CUTS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.5)  # fixed values: the cuts to try, and the one without a better
NO_CUT = 0.35


def calibrated(scored: DataFrame, gold: str, classes: Sequence[str], cuts: Sequence[float] = CUTS) -> DataFrame:
    """cut, tp, fp, fn, f1 of each cut over rows (scores, gold), in one aggregate."""
    def counts(c: float) -> F.Column:
        said = chosen(F.col("scores"), classes, F.lit(c))
        both = F.size(F.array_intersect(said, gold))
        return F.struct(F.lit(c).alias("cut"), F.sum(both).alias("tp"), F.sum(F.size(said) - both).alias("fp"), F.sum(F.size(F.array_distinct(gold)) - both).alias("fn"))

    out = scored.agg(F.array(*[counts(c) for c in cuts]).alias("e")).select(F.inline("e"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def best_cut(swept: DataFrame) -> float:
    """The cut of the highest micro-F1, the smallest on ties; 0.35 where every one is 0. One row reaches the driver."""
    row = swept.agg(F.max("f1").alias("f1"), F.max_by("cut", F.struct("f1", -F.col("cut"))).alias("cut")).first()
    return row["cut"] if row["f1"] else NO_CUT


def multi_label(rows: DataFrame, key: str, labels: str, classes: Sequence[str]) -> tuple[dict, float]:
    """Heads fitted on all rows (features, labels), and the one cut that is best for heads fitted without a held-out 15 %."""
    held = holdout(key)
    trial = label_heads(rows.where(~held), labels, classes)
    cut = best_cut(calibrated(label_scores(rows.where(held), trial), labels, classes))
    return label_heads(rows, labels, classes), cut


# ---------------------------------------------------------------- a tagger of tokens

#: Words before a place, and how many words a token sees on either side.
PREPOSITIONS = ("in", "at", "for", "near", "from", "to", "by", "around", "of", "on", "over")
AROUND = (-2, -1, 1, 2)
TAGS = ("O", "B-LOC", "I-LOC", "B-TIME", "I-TIME")


def tagged_tokens(rows: DataFrame, key: str, text: str = "text", spans: str | None = None) -> DataFrame:
    """key, pos, token, start, end, tag: tokens with the tag of the span (ARRAY<STRUCT<slot, start, end>>, LOC or TIME) they touch; O without spans."""
    each = marks.located(rows, [key], text).drop("gap")
    if spans is None:
        return each.withColumn("tag", F.lit("O"))
    with_spans = each.join(rows.select(key, F.col(spans).alias("_s")), key)
    hit = F.get(F.filter("_s", lambda s: (F.col("start") < s["end"]) & (s["start"] < F.col("end"))), F.lit(0))
    first = F.row_number().over(Window.partitionBy(key, hit["start"]).orderBy("pos")) == 1
    return with_spans.withColumn("tag", F.when(hit.isNull(), "O").otherwise(F.concat(F.when(first, "B-").otherwise("I-"), hit["slot"]))).drop("_s")


def frequent_words(tokens_: DataFrame, least: int) -> DataFrame:
    """word: lower-cased tokens that are used often enough to be known by name."""
    return tokens_.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def token_features(tokens_: DataFrame, key: str, known: DataFrame, metrics: Sequence[str] = ()) -> DataFrame:
    """tokens with seen: ARRAY<STRING>, what a tagger may look at: the word if it is known, its shape, ends and shingles, and its neighbours.

    Rare words are hidden, so a place can be told by its context and shape only, as an unseen one must be.
    """
    low = F.lower("token")
    shape = F.when(F.col("token").rlike(r"^[^a-z]*[A-Z][^a-z]*$"), "UPPER").when(F.col("token").rlike(r"^[A-Z][^A-Z]*$"), "Title").when(F.col("token").rlike(r"^[^A-Z]*[a-z][^A-Z]*$"), "lower").when(F.col("token").rlike(r"^\d+$"), "digit").otherwise("mixed")
    t = tokens_.withColumns({"_low": low, "_shape": shape}).join(known.select(F.col("word").alias("_low"), F.lit(True).alias("_known")), "_low", "left")
    t = t.withColumn("_word", F.when(F.col("_known"), F.col("_low")).otherwise("<rare>"))
    w = Window.partitionBy(key).orderBy("pos")
    last = F.max("pos").over(Window.partitionBy(key))
    size = F.char_length("_low")
    grams = F.when(size >= 3, F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.concat(F.lit("ng="), F.substring("_low", i, F.lit(3)))))

    def named(name: str, value: F.Column) -> F.Column:
        return F.concat(F.lit(f"{name}="), value.cast("string"))

    parts = [
        named("w", F.col("_word")), named("shape", F.col("_shape")), named("pre3", F.left("_low", F.lit(3))), named("suf3", F.right("_low", F.lit(3))), named("suf4", F.right("_low", F.lit(4))), named("len", F.least(size, F.lit(10))),
        named("digit", F.col("token").rlike(r"\d")), named("colon", F.contains(F.col("token"), F.lit(":"))), named("bos", F.col("pos") == 0), named("from_end", F.least(last - F.col("pos"), F.lit(6))),
        named("prep", F.coalesce(F.lag("_low").over(w).isin(*PREPOSITIONS), F.lit(False))), named("metric", F.col("_low").isin(*metrics) if metrics else F.lit(False)),
    ]
    for k in AROUND:
        beside = (lambda c, k=k: F.lag(c, -k).over(w)) if k < 0 else (lambda c, k=k: F.lead(c, k).over(w))
        parts += [named(f"w{k:+d}", F.coalesce(beside("_word"), F.lit("<pad>"))), named(f"shape{k:+d}", F.coalesce(beside("_shape"), F.lit("<pad>")))]
    seen = F.concat(F.array(*parts), F.coalesce(grams, F.array().cast("array<string>")))
    return t.withColumn("seen", seen).drop("_low", "_shape", "_known", "_word")


class Tagger:
    """A multinomial classifier over hashed features of tokens."""

    def __init__(self, least: int = 15, features: int = 1 << 14, metrics: Sequence[str] = ()):
        self.least, self.metrics, self.hash = least, metrics, HashingTF(inputCol="seen", outputCol="features", numFeatures=features, binary=True)

    def fit(self, rows: DataFrame, key: str, text: str = "text", spans: str = "marks") -> Tagger:
        tokens_ = written(tagged_tokens(rows, key, text, spans), "tagger-tokens")
        self.known = written(frequent_words(tokens_, self.least), "tagger-words")
        tag = F.array_position(F.array(*map(F.lit, TAGS)), F.col("tag")) - 1
        ready = self.hash.transform(token_features(tokens_, key, self.known, self.metrics)).withColumn("y", tag.cast("double"))
        self.model = LogisticRegression(labelCol="y", family="multinomial", maxIter=40, regParam=0.0005).fit(written(ready.select("features", "y"), "tagger-rows"))
        return self

    def tag(self, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, pos, token, start, end, tag."""
        ready = self.hash.transform(token_features(tagged_tokens(rows, key, text), key, self.known, self.metrics))
        tag = F.get(F.array(*map(F.lit, TAGS)), F.col("prediction").cast("int"))
        return self.model.transform(ready).select(key, "pos", "token", "start", "end", tag.alias("tag"))


def spans_of_tags(tagged: DataFrame, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, slot, start, end, span: runs of tags as verbatim slices. B begins a span, and so does an I after another kind or none: no run of tags is undecodable."""
    w = Window.partitionBy(key).orderBy("pos")
    slot = F.when(F.col("tag") != "O", F.substring("tag", 3, 10))
    begins = F.col("tag").startswith("B-") | ((F.col("tag") != "O") & ~F.coalesce(F.lag(slot).over(w) == slot, F.lit(False)))
    runs = tagged.withColumns({"slot": slot, "run": F.sum(begins.cast("int")).over(w)}).where("slot IS NOT NULL").groupBy(key, "run", "slot").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.join(rows.select(key, F.col(text).alias("_t")), key).select(key, "slot", "start", "end", F.expr("substring(_t, start + 1, end - start)").alias("span"))


CLOCK = r"(?i)\b\d{1,2}(?::\d{2})?\s*(?:am|pm)(?:\s*to\s*\d{1,2}(?::\d{2})?\s*(?:am|pm))?\b"  # fixed values: times that are told by their form
DURATION = r"(?i)\b(?:next\s+)?\d+\s*(?:days?|hours?|hrs?|minutes?|mins?|weeks?|months?)\b"


def with_written_times(spans: DataFrame, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """spans (key, slot, start, end, span) with clock times and durations by their form, which win over TIME spans that they overlap; clocks win over durations."""
    at = {k: marks.located(rows, [key], text, p).select(key, "start", "end", F.col("token").alias("span"), F.lit(i).alias("o")) for i, (k, p) in enumerate((("clock", CLOCK), ("duration", DURATION)))}
    sure = marks.longest_first(at["clock"].unionByName(at["duration"]), [key], [F.col("o"), F.col("start")]).select(key, F.lit("TIME").alias("slot"), "start", "end", "span")
    s = sure.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    free = spans.join(s, (F.col(key) == F.col("_k")) & (F.col("slot") == "TIME") & (F.col("start") < F.col("_b")) & (F.col("_a") < F.col("end")), "left_anti")
    return free.unionByName(sure)


def token_rows(rows: DataFrame, key: str, text: str, spans: str) -> DataFrame:
    """key, pos, token, before, after, label: one row per token with BIO labels for the tokens of the spans (an array)."""
    t = rows.select(key, F.col(spans), F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    w = Window.partitionBy(key).orderBy("pos")
    span_words = F.transform(F.flatten(F.transform(spans, lambda s: tokens(s))), F.lower)
    inside = F.array_contains(span_words, F.lower("token"))
    t = t.withColumn("inside", inside).withColumn("begins", F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(False)))
    label = F.when(F.col("begins"), "B").when(F.col("inside"), "I").otherwise("O")
    return t.select(key, "pos", "token", F.lag("token").over(w).alias("before"), F.lead("token").over(w).alias("after"), label.alias("label"))


def decoded(tagged: DataFrame, key: str) -> DataFrame:
    """key, spans: runs of B and I tokens, in order."""
    w = Window.partitionBy(key).orderBy("pos")
    start = (F.col("label") == "B") | ((F.col("label") == "I") & (F.coalesce(F.lag("label").over(w), F.lit("O")) == "O"))
    runs = tagged.withColumn("run", F.sum(start.cast("int")).over(w)).where("label != 'O'")
    each = runs.groupBy(key, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x.token), " ").alias("span"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "span"))), lambda x: x.span).alias("spans"))
