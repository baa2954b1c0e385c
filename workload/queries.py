"""The registered queries. Each takes a session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.functions import labels, normalize, risk, rules
from textrisk.functions.risk import RiskConfig
from textrisk.operators import checks, joins, metrics, multiset, profile, sketches
from textrisk.operators import split as splits
from textrisk.operators.features import (
    CHAR_BLOCK,
    WORD_BLOCK,
    TfidfBlock,
    fit_blocks,
    term_weights,
    tfidf_vectors,
    vocabulary,
)
from textrisk.operators.fingerprint import fingerprint
from textrisk.operators.models import (
    BatchDetector,
    EmbeddingDetector,
    TextBatchDetector,
    TfidfDetector,
    feature_union,
    keyword_detector,
)
from textrisk.operators.ordering import exact_percentiles, with_row_index
from textrisk.plans import evaluate, freeze, registry, train
from textrisk.plans.scan import compare_detectors, scan, scan_batch, score_components
from textrisk.sources.scratch import materialized, scratch_path
from textrisk.sources.tables import (
    load_labeled,
    read_csv,
    read_parquet,
    read_report,
    write_csv,
    write_report,
)
from textrisk.sources import schemas
from textrisk.streaming.scan_stream import read_text_stream, scan_stream
from workload.overlay import lead_in, overlaid, partitions

CONFIG = RiskConfig()
# Stand-in detectors: a probability by keyword.
KEYWORDS = ("ignore", "bỏ qua")
OTHER_KEYWORDS = ("reveal", "gửi", "ignore")
DETECTOR = keyword_detector(KEYWORDS, 0.96, 0.05, "keyword_a")
OTHER_DETECTOR = keyword_detector(OTHER_KEYWORDS, 0.91, 0.1, "keyword_b")
ML_THRESHOLD = 0.48
HEURISTIC_THRESHOLD = 0.40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(values: Column | str) -> Column:
    return F.array_join(values, "|")


def r9(value: Column | str) -> Column:
    return F.round(value, 9)


# ---- text ---------------------------------------------------------------------------------


def normalize_text(spark, sf_dir):
    return normalize.with_normalized(overlaid(spark, sf_dir)).select("Id", "normalized_text")


def comparison_form(spark, sf_dir):
    return normalize.with_normalized(overlaid(spark, sf_dir)).select("Id", "comparison_text")


def anomaly_signals(spark, sf_dir):
    out = normalize.with_normalized(overlaid(spark, sf_dir))
    return out.select("Id", "anomaly_score", joined("signals").alias("signals"))


def _scored(spark, sf_dir):
    return score_components(overlaid(spark, sf_dir), DETECTOR)


def sanitize(spark, sf_dir):
    return _scored(spark, sf_dir).select("Id", "decision", "sanitized_text")


def rule_hits(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "Id",
        joined("matched_rules").alias("matched_rules"),
        joined("rule_reasons").alias("rule_reasons"),
    )


def negated_exfil(spark, sf_dir):
    """Documents with an exfiltration phrase, and whether it survives the negation check."""
    family = next(f for f in rules.RULE_FAMILIES if f.rule_id == rules.NEGATABLE_RULE)
    text = F.col("folded")
    compared = normalize.with_normalized(overlaid(spark, sf_dir))
    out = compared.select("Id", F.replace("comparison_text", F.lit("ı"), F.lit("i")).alias("folded"))
    found = rules.pattern_hit(text, family.english) | rules.pattern_hit(text, family.vietnamese)
    kept = rules.family_hit(text, family)
    return out.filter(found).select("Id", kept.cast("int").alias("kept"))


def heuristic_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("Id", "heuristic_score")


def rule_hit_counts(spark, sf_dir):
    return rules.rule_hit_counts(_scored(spark, sf_dir))


def keyword_scores(spark, sf_dir):
    return DETECTOR.score(overlaid(spark, sf_dir), "text", "ml_score").select("Id", "ml_score")


def risk_decision(spark, sf_dir):
    return _scored(spark, sf_dir).select("Id", "risk_score", "decision", "risk_level")


def reasons(spark, sf_dir):
    return _scored(spark, sf_dir).select("Id", joined("reasons").alias("reasons"))


# ---- scans --------------------------------------------------------------------------------


def _flattened(nested: DataFrame) -> DataFrame:
    return nested.select(
        "Id",
        "decision",
        "risk_level",
        "risk_score",
        F.col("ml.model").alias("model"),
        F.col("ml.jailbreak_probability").alias("jailbreak_probability"),
        F.col("prompt_injection.score").alias("injection_score"),
        joined("prompt_injection.matched_rules").alias("matched_rules"),
        F.col("text_anomalies.score").alias("anomaly_score"),
        joined("text_anomalies.signals").alias("signals"),
        joined("reasons").alias("reasons"),
        "raw_text",
        "normalized_text",
        "sanitized_text",
        F.col("source_metadata")["lang"].alias("lang"),
    )


def scan_nested(spark, sf_dir):
    source = overlaid(spark, sf_dir).withColumn("meta", F.create_map(F.lit("lang"), "lang"))
    return _flattened(scan(source, DETECTOR, metadata_col="meta"))


def scan_batch_flat(spark, sf_dir):
    return scan_batch(overlaid(spark, sf_dir), DETECTOR)


def scan_conversations(spark, sf_dir):
    source = read_parquet(spark, f"{sf_dir}/conversations.parquet", partitions(spark))
    turns = source.select(
        F.concat_ws("-", "conv_id", "turn").alias("Id"),
        F.concat(lead_in(F.col("conv_id") + F.col("turn")), F.col("text")).alias("text"),
    )
    return scan_batch(turns, DETECTOR)


def scan_pages(spark, sf_dir):
    source = read_parquet(spark, f"{sf_dir}/pages.parquet", partitions(spark))
    pages = source.select("page_id", F.concat(lead_in(F.col("page_id")), F.col("html")).alias("html"))
    return scan_batch(pages, DETECTOR, text_col="html", id_col="page_id")


def scan_as_stream(spark, sf_dir):
    """The documents as a stream of files that arrive in two sets; the stream stops after the
    first and is started again on its checkpoint for the second."""
    folder = scratch_path(spark, "scan-stream")
    documents = overlaid(spark, sf_dir).select("Id", "text")
    for turn in (0, 1):
        documents.where(F.col("Id") % 2 == turn).write.mode("append").parquet(f"{folder}/in")
        stream = read_text_stream(spark, f"{folder}/in", documents.schema)
        query = scan_stream(stream, DETECTOR, f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return spark.read.parquet(f"{folder}/out")


def decision_counts(spark, sf_dir):
    return profile.decision_counts(_scored(spark, sf_dir))


def id_fallback(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return with_row_index(turns, ("conv_id", "turn"), "Id")


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    source = overlaid(spark, sf_dir).select(F.col("Id").cast("string").alias("Id"), "text")
    write_csv(source, path)
    return read_csv(spark, path, schemas.UNLABELED)


def report_roundtrip(spark, sf_dir):
    """The counts per language and source as a written report, read back."""
    path = scratch_path(spark, "report")
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count("*").alias("rows"), F.max(F.when(F.col("n_chars") > 20_000, F.col("n_chars"))).alias("longest")
    )
    write_report(counts, path)
    return read_report(spark, path, counts.schema)


# ---- checks, labels, splits ---------------------------------------------------------------


def _labeled(spark, sf_dir):
    """Labeled documents in the training layout, with mixed label spellings."""
    label = F.when(
        F.col("doc_id") % 2 == 0, F.when(F.col("toxic") == 1, "jailbreak").otherwise("benign")
    ).otherwise(F.col("toxic").cast("string"))
    documents, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(marks, "doc_id").select(
        F.col("doc_id").cast("string").alias("Id"), "text", label.alias("label")
    )


def load_labeled_table(spark, sf_dir):
    out = load_labeled(_labeled(spark, sf_dir))
    return out.select("Id", F.char_length("text").cast("long").alias("n_chars"), "label", "target")


def null_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return checks.null_report(rows, ["doc_id", "text", "quality", "toxic"])


def unknown_labels(spark, sf_dir):
    label = F.when(F.col("lang") == "en", "benign").when(F.col("lang") == "fr", "jailbreak")
    rows = table(spark, sf_dir, "documents").withColumn("mark", F.coalesce(label, "lang"))
    return checks.unknown_labels(rows, "mark", labels.TRAINING_LABELS)


def _toxic(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("Id"), F.col("toxic").alias("target"), "doc_id"
    )


def stratified_split(spark, sf_dir):
    return splits.with_partition(_toxic(spark, sf_dir).select("Id", "target"))


def _stored_split(spark, sf_dir):
    return materialized(splits.split_table(stratified_split(spark, sf_dir)), "split")


def split_reuse(spark, sf_dir):
    frame = _toxic(spark, sf_dir).select("Id", "target")
    applied = splits.apply_split(frame, _stored_split(spark, sf_dir))
    return applied.filter(F.col("partition") == "train")


def split_check(spark, sf_dir):
    frame = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Id"))
    return checks.split_check(frame, _stored_split(spark, sf_dir))


def score_range_violations(spark, sf_dir):
    value = F.col("value")
    scores = table(spark, sf_dir, "events").select(
        (value / 100).alias("ml_score"),
        (value / 500).alias("heuristic_score"),
        (value - 1).alias("unicode_score"),
    )
    return checks.score_range_violations(scores, scores.columns)


def truth_labels(spark, sf_dir):
    toxic = F.col("toxic") == 1
    spelled = (
        F.when(F.col("doc_id") % 3 == 0, F.when(toxic, "attack").otherwise("safe"))
        .when(F.col("doc_id") % 3 == 1, F.when(toxic, "jailbreak").otherwise("benign"))
        .otherwise(F.col("toxic").cast("string"))
    )
    rows = table(spark, sf_dir, "labels").select("doc_id", spelled.alias("ground_truth"))
    return labels.with_truth(rows, "target").select(F.col("doc_id").alias("Id"), "target")


def truth_unknown(spark, sf_dir):
    """Ground-truth values outside the domain."""
    return checks.unknown_labels(table(spark, sf_dir, "conversations"), "role", labels.TRUTH_LABELS)


def metrics_unscored(spark, sf_dir):
    """Metrics of every document: those without a label, and null scores, are in no cell."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("Id"))
    rows = documents.join(_tied_scores(spark, sf_dir).drop("doc_id"), "Id", "left")
    prediction = risk.over_threshold(F.col("score"), 0.5)
    return _rounded(metrics.binary_metrics(rows.withColumn("prediction", prediction)))


def dataset_summary(spark, sf_dir):
    rows = _labeled(spark, sf_dir)
    return profile.dataset_summary(load_labeled(rows), table(spark, sf_dir, "documents"))


def label_distribution(spark, sf_dir):
    return profile.value_counts(_labeled(spark, sf_dir), "label")


def fingerprint_documents(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "documents"))


def fingerprint_merge(spark, sf_dir):
    """The fingerprint of all documents from those of each language and source."""
    documents = table(spark, sf_dir, "documents")
    whole = multiset.row_limbs(documents)
    limbs = documents.select("lang", "source", whole.alias("_limbs"))
    parts = limbs.groupBy("lang", "source").agg(
        F.count("*").alias("rows"),
        F.array(*(F.sum(F.get("_limbs", F.lit(i))) for i in range(multiset.LIMBS))).alias("limbs"),
    )
    return multiset.state_fingerprint(multiset.merged_states(parts))


def external_receipt(spark, sf_dir):
    """A model is fitted, frozen, loaded and run over all vectors; what its receipt says of them."""
    vectors = _vectors(spark, sf_dir)
    folder = scratch_path(spark, "external")
    freeze.freeze(spark, {"model_b": train.train_embeddings(vectors, name="model_b")}, f"{folder}/frozen")
    text = F.when(F.col("Id") % 9 != 0, F.concat(F.lit("vector "), "Id"))
    inputs = vectors.select("Id", text.alias("text"), "embedding")
    receipt = freeze.predict_external(spark, f"{folder}/frozen", inputs, f"{folder}/out")
    written = spark.read.parquet(f"{folder}/out/predictions")
    fits = multiset.multiset_fingerprint(written) == receipt["prediction_fingerprint"]
    return written.agg(
        F.lit(receipt["rows"]).cast("bigint").alias("rows"),
        F.lit(receipt["rejected_rows"]).cast("bigint").alias("rejected_rows"),
        F.count("decision").alias("decisions"),
        F.lit(receipt["input_fingerprint"]).alias("input_fingerprint"),
        F.lit(int(fits)).alias("predictions_fit"),
        F.lit(int(0 < receipt["p50_ms_per_document"] <= receipt["p95_ms_per_document"])).alias("timed"),
    )


def class_weights(spark, sf_dir):
    return splits.class_weights(_toxic(spark, sf_dir)).withColumn("weight", r9("weight"))


# ---- metrics ------------------------------------------------------------------------------


def _tied_scores(spark, sf_dir, factor=37, modulus=101):
    score = (F.col("doc_id") * factor % modulus) / 100.0
    return _toxic(spark, sf_dir).withColumn("score", score)


def _rounded(df: DataFrame) -> DataFrame:
    ratios = [*metrics.RATIOS, "roc_auc", "utility", "threshold"]
    return df.select(*[r9(c).alias(c) if c in ratios else F.col(c) for c in df.columns])


def _projection(vector, period):
    """A fixed projection of all components: weights run through -1 to 1 in ``period`` steps."""
    weights = F.transform(vector, lambda x, i: x.cast("double") * ((i % period) * 2 - (period - 1)) / (period - 1.0))
    return F.aggregate(weights, F.lit(0.0), lambda total, x: total + x)


def threshold_predict(spark, sf_dir):
    prediction = risk.over_threshold(F.col("score"), ML_THRESHOLD)
    return _tied_scores(spark, sf_dir).select("Id", "score", prediction.alias("prediction"))


def softmax_prob(spark, sf_dir):
    logits = F.array(*(_projection(F.col("embedding"), period) for period in (5, 7)))
    probability = r9(risk.softmax_positive(logits))
    return table(spark, sf_dir, "embeddings").select("vec_id", probability.alias("probability"))


def binary_metrics(spark, sf_dir):
    rows = _tied_scores(spark, sf_dir).withColumn(
        "prediction", risk.over_threshold(F.col("score"), 0.5)
    )
    return _rounded(metrics.binary_metrics(rows))


def roc_auc(spark, sf_dir):
    """AUC of tied scores over labels and of untied scores over embeddings."""
    tied = _tied_scores(spark, sf_dir).select(F.lit("labels").alias("source"), "target", "score")
    untied = table(spark, sf_dir, "embeddings").select(
        F.lit("embeddings").alias("source"),
        (F.col("label") < 5).cast("int").alias("target"),
        r9(_projection(F.col("embedding"), 5)).alias("score"),
    )
    rows = tied.unionAll(untied).withColumn("prediction", risk.over_threshold(F.col("score"), 0.5))
    out = metrics.binary_metrics(rows, score="score", by=["source"])
    return _rounded(out).select("source", "roc_auc", "support_benign", "support_jailbreak")


def threshold_sweep(spark, sf_dir):
    return _rounded(metrics.threshold_sweep(_tied_scores(spark, sf_dir)))


def best_threshold(spark, sf_dir):
    return _rounded(metrics.best_threshold(metrics.threshold_sweep(_tied_scores(spark, sf_dir))))


def select_primary(spark, sf_dir):
    def candidate(name, factor, modulus):
        sweep = metrics.threshold_sweep(_tied_scores(spark, sf_dir, factor, modulus))
        return metrics.best_threshold(sweep).select(
            F.lit(name).alias("name"),
            F.lit("trained").alias("status"),
            "threshold",
            "recall_jailbreak",
            "f1_jailbreak",
            "false_positive_rate",
        )

    pair = candidate("model_a", 37, 101).unionAll(candidate("model_b", 53, 97))
    return _rounded(metrics.select_primary(pair))


def latency_summary(spark, sf_dir):
    out = exact_percentiles(table(spark, sf_dir, "events"), "value", (0.5, 0.95))
    return out.select("n", *[r9(c).alias(c) for c in ("mean", "p50", "p95")])


# ---- evaluation ---------------------------------------------------------------------------


def latency_sketch(spark, sf_dir):
    """Percentiles from sketches of a hundred batches, and whether they are within the sketch's error."""
    events = table(spark, sf_dir, "events").select(F.col("value").cast("double").alias("value"), (F.col("event_id") % 100).alias("batch"))
    parts = materialized(sketches.quantile_sketches(events, "value", ["batch"]), "sketches")
    fractions = {"p50": 0.5, "p95": 0.95}
    found = materialized(sketches.sketch_percentiles(sketches.merged_sketches(parts), list(fractions.values())), "percentiles")
    places = events.select("value", *(found.select(n).scalar().alias(n) for n in fractions)).agg(
        *(F.avg((F.col("value") < F.col(n)).cast("double")).alias(f"{n}_low") for n in fractions),
        *(F.avg((F.col("value") <= F.col(n)).cast("double")).alias(f"{n}_high") for n in fractions),
    )
    bound = sketches.RANK_ERROR
    inside = [
        ((F.col(f"{n}_low") <= q + bound) & (F.col(f"{n}_high") >= q - bound)).cast("int").alias(f"{n}_within") for n, q in fractions.items()
    ]
    return places.select(found.select("n").scalar().alias("n"), r9(found.select("mean").scalar()).alias("mean"), *inside)


def _truth(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"))
    marks = table(spark, sf_dir, "labels")
    name = F.when(F.col("toxic") == 1, "attack").otherwise("safe")
    return marks.join(langs, "doc_id").select(
        F.col("doc_id").alias("Id"), name.alias("label"), "category"
    )


def _labeled_inputs(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("Id"))
    return overlaid(spark, sf_dir).join(ids, "Id")


def _predictions(spark, sf_dir):
    return scan_batch(_labeled_inputs(spark, sf_dir), DETECTOR)


def _evaluated(spark, sf_dir):
    return evaluate.with_outcome(_predictions(spark, sf_dir), _truth(spark, sf_dir))


def eval_join(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(
        "Id", "risk_score", "decision", F.col("_target").alias("target"), "prediction"
    )


def join_mismatch(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Id"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("Id"))
    return joins.join_mismatch(documents, marks)


def eval_full(spark, sf_dir):
    return _rounded(evaluate.full_metrics(_evaluated(spark, sf_dir)))


def ablation(spark, sf_dir):
    out = evaluate.ablation(
        _evaluated(spark, sf_dir), CONFIG, ML_THRESHOLD, HEURISTIC_THRESHOLD
    )
    return _rounded(out)


def category_breakdown(spark, sf_dir):
    return _rounded(evaluate.category_breakdown(_evaluated(spark, sf_dir)))


def _errors(spark, sf_dir):
    return evaluate.error_table(
        _evaluated(spark, sf_dir), _labeled_inputs(spark, sf_dir)
    ).withColumnRenamed("_target", "target")


def error_analysis(spark, sf_dir):
    return _errors(spark, sf_dir)


def error_examples(spark, sf_dir):
    return evaluate.error_examples(_errors(spark, sf_dir)).select("Id", "error_type", "decision")


def sample_head(spark, sf_dir):
    return train.sample_head(table(spark, sf_dir, "documents"), "doc_id", 100).select(
        "doc_id", "lang", "n_chars"
    )


def model_compare(spark, sf_dir):
    pair = ("a", DETECTOR), ("b", OTHER_DETECTOR)
    out = compare_detectors(overlaid(spark, sf_dir), *pair)
    return out.withColumn("disagrees", F.col("disagrees").cast("int"))


# ---- features and models ------------------------------------------------------------------


def _term_summary(spark, sf_dir, spec):
    """Every kept term with its document weights summed over all documents."""
    documents = read_parquet(spark, f"{sf_dir}/documents.parquet", partitions(spark))
    vocab = materialized(vocabulary(documents, spec), f"vocabulary-{spec.name}")
    block = TfidfBlock.from_vocabulary(vocab, spec)
    weights = term_weights(tfidf_vectors(documents, [block], out_col="v"), "v")
    return vocab.join(block.terms.select("position", "term"), "term").join(weights, "position").select(
        "term",
        "doc_freq",
        "corpus_freq",
        F.round("idf", 6).alias("idf"),
        F.round("weight_sum", 6).alias("weight_sum"),
    )


def tfidf_word(spark, sf_dir):
    return _term_summary(spark, sf_dir, WORD_BLOCK)


def tfidf_char(spark, sf_dir):
    return _term_summary(spark, sf_dir, CHAR_BLOCK)


def _training_frame(spark, sf_dir):
    """All documents with lead-ins; the positives are those whose lead-in is an attack."""
    attack = (F.col("Id") % 16).isin(1, 2, 3, 4, 5, 6, 7, 9, 13, 15)
    return overlaid(spark, sf_dir).select("Id", "text", attack.cast("int").alias("target"))


def feature_union_sizes(spark, sf_dir):
    frame = _training_frame(spark, sf_dir)
    blocks = fit_blocks(frame, (WORD_BLOCK, CHAR_BLOCK))
    parts = F.unwrap_udt("features")
    return feature_union(frame, blocks).select(
        "Id", F.size(parts["indices"]).alias("terms"), parts["size"].alias("dimensions")
    )


# Gradients shorter than this share of that at zero, so that scores can be set against another solver's.
CLOSE, CLOSER = 1e-6, 1e-10


def _report(trained):
    """The report beside the certificate, its gradient to three digits."""
    certificate = trained.certificate.select(
        F.lit(trained.name).alias("name"), "coefficients", F.round("largest_gradient", 3).alias("largest_gradient")
    )
    return _rounded(trained.report.drop("training_seconds")).join(certificate, "name")


def train_model_a(spark, sf_dir):
    return _report(train.train_tfidf(_training_frame(spark, sf_dir), tolerance=CLOSE))


def score_model_a(spark, sf_dir):
    """Every document scored by a model of all documents."""
    frame = _training_frame(spark, sf_dir)
    detector = TfidfDetector.fit(frame, tolerance=CLOSE)
    scored = detector.score(frame, "text", "score").select("Id", "target", "score")
    predicted = risk.over_threshold(F.col("score"), detector.threshold)
    return scored.select("Id", "target", F.round("score", 3).alias("score"), predicted.alias("prediction"))


def scoring_paths(spark, sf_dir):
    """Documents whose score as a join of terms differs from that of their vector, per target."""
    frame = materialized(_training_frame(spark, sf_dir), "training-frame")
    detector = TfidfDetector.fit(frame)
    joins = detector.relational_score(frame, "text", "joined")
    both = detector.score(frame, "text", "score").select("Id", "target", "score").join(joins, "Id")
    apart = F.abs(F.col("score") - F.col("joined")) > 1e-9
    return both.groupBy("target").agg(F.count("*").alias("rows"), F.count_if(apart).alias("apart"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("Id"), "embedding", (F.col("label") < 5).cast("int").alias("target")
    )


def train_model_b(spark, sf_dir):
    return _report(train.train_embeddings(_vectors(spark, sf_dir), tolerance=CLOSER))


def model_report(spark, sf_dir):
    """Reports of two fits in one registry, the selected one marked."""
    first = train.train_embeddings(_vectors(spark, sf_dir), name="model_a", tolerance=CLOSER).report
    squares = _vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x * x))
    second = train.train_embeddings(squares, name="model_b", tolerance=CLOSER).report
    return _rounded(train.registry(first.unionAll(second)).drop("training_seconds"))


def score_model_b(spark, sf_dir):
    """Every vector scored by a model of all vectors."""
    detector = EmbeddingDetector.fit(_vectors(spark, sf_dir), tolerance=CLOSER)
    scored = detector.score(_vectors(spark, sf_dir), "text", "score")
    return scored.select("Id", "target", F.round("score", 4).alias("score"))


def registry_roundtrip(spark, sf_dir):
    """Two versions of a model are published; the current one is loaded and scores every vector."""
    path = scratch_path(spark, "registry")
    detector = EmbeddingDetector.fit(_vectors(spark, sf_dir), tolerance=CLOSER)
    registry.publish_detector(spark, path, replace(detector, threshold=0.9))
    registry.publish_detector(spark, path, detector, {"threshold": detector.threshold})
    loaded = registry.current_detector(spark, path)
    scored = loaded.score(_vectors(spark, sf_dir), "text", "score")
    predicted = risk.over_threshold(F.round("score", 4), loaded.threshold).alias("prediction")
    number = F.lit(registry.published(spark, path)[0])
    return scored.select("Id", number.alias("version"), F.round("score", 4).alias("score"), predicted)


def _linear_model():
    """A fixed linear model, built in the worker that runs it."""
    import numpy as np

    def predict(batch: np.ndarray) -> np.ndarray:
        weights = (np.arange(batch.shape[1]) % 7 - 3) / 10.0
        return 1.0 / (1.0 + np.exp(-(batch.astype("float64") @ weights)))

    return predict


def _word_lengths():
    """A fixed model of texts: the ids are the lengths of words, the margin their mean."""
    import numpy as np

    def tokenize(text: str) -> list[int]:
        return [len(word) for word in text.split(" ") if word]

    def predict(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        mean = (ids * mask).sum(axis=1) / np.maximum(1, mask.sum(axis=1))
        return 1.0 / (1.0 + np.exp(5.0 - mean))

    return tokenize, predict


def predict_text(spark, sf_dir):
    """Batched inference on whole documents, of which the model reads the first 256 words."""
    documents = read_parquet(spark, f"{sf_dir}/documents.parquet", partitions(spark))
    detector = TextBatchDetector("word_lengths", _word_lengths)
    scored = detector.score(documents.select("doc_id", "text"), "text", "probability")
    return scored.select("doc_id", r9("probability").alias("probability"))


def predict_batch(spark, sf_dir):
    detector = BatchDetector("linear", _linear_model, "embedding", (64,), batch_size=256)
    scored = detector.score(table(spark, sf_dir, "embeddings"), "text", "probability")
    return scored.select("vec_id", r9("probability").alias("probability"))


QUERIES = {
    "scan_batch_flat": scan_batch_flat,
    "scan_nested": scan_nested,
    "scan_stream": scan_as_stream,
    "scan_conversations": scan_conversations,
    "scan_pages": scan_pages,
    "normalize_text": normalize_text,
    "comparison_form": comparison_form,
    "anomaly_signals": anomaly_signals,
    "sanitize": sanitize,
    "rule_hits": rule_hits,
    "negated_exfil": negated_exfil,
    "heuristic_score": heuristic_score,
    "rule_hit_counts": rule_hit_counts,
    "keyword_detector": keyword_scores,
    "risk_decision": risk_decision,
    "reasons": reasons,
    "decision_counts": decision_counts,
    "id_fallback": id_fallback,
    "csv_roundtrip": csv_roundtrip,
    "report_roundtrip": report_roundtrip,
    "load_labeled": load_labeled_table,
    "null_report": null_report,
    "unknown_labels": unknown_labels,
    "stratified_split": stratified_split,
    "split_reuse": split_reuse,
    "split_check": split_check,
    "score_range_violations": score_range_violations,
    "truth_labels": truth_labels,
    "truth_unknown": truth_unknown,
    "metrics_unscored": metrics_unscored,
    "dataset_summary": dataset_summary,
    "label_distribution": label_distribution,
    "fingerprint": fingerprint_documents,
    "fingerprint_merge": fingerprint_merge,
    "external_receipt": external_receipt,
    "class_weights": class_weights,
    "threshold_predict": threshold_predict,
    "softmax_prob": softmax_prob,
    "binary_metrics": binary_metrics,
    "roc_auc": roc_auc,
    "threshold_sweep": threshold_sweep,
    "best_threshold": best_threshold,
    "select_primary": select_primary,
    "latency_summary": latency_summary,
    "latency_sketch": latency_sketch,
    "eval_join": eval_join,
    "join_mismatch": join_mismatch,
    "eval_full": eval_full,
    "ablation": ablation,
    "category_breakdown": category_breakdown,
    "error_analysis": error_analysis,
    "error_examples": error_examples,
    "sample_head": sample_head,
    "model_compare": model_compare,
    "tfidf_word": tfidf_word,
    "tfidf_char": tfidf_char,
    "feature_union": feature_union_sizes,
    "train_model_a": train_model_a,
    "score_model_a": score_model_a,
    "scoring_paths": scoring_paths,
    "train_model_b": train_model_b,
    "score_model_b": score_model_b,
    "registry_roundtrip": registry_roundtrip,
    "model_report": model_report,
    "predict_batch": predict_batch,
    "predict_text": predict_text,
}
