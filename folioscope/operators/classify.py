"""Classification of changes: features, rules, a model hook, arbitration."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.similarity import change_ratio, line_changes
from folioscope.operators.diffing import of_all
from folioscope.storage import exists, written

#: Cue words, tested as substrings of the lower-cased text.
OBLIGATION = ("must", "shall", "required", "require", "mandatory", "prohibited", "forbidden", "may not")
NEGATION = ("not", "no", "never", "without", "none", "cannot", "can't", "won't", "unless")
SCOPE = ("all", "any", "only", "except", "including", "excluding", "solely", "limited to", "at least", "at most", "across", "within")
#: Patterns (digits and word ends by Unicode) of numbers, percentages, amounts, dates and table rows.
NUMBERS = r"(?U)\b\d+(?:,\d{3})*(?:\.\d+)?\b"
PERCENTS = r"(?U)\b\d+(?:\.\d+)?\s?%\b"
CURRENCIES = r"(?iU)(?:[$€£]\s?\d+(?:,\d{3})*(?:\.\d+)?|\b(?:usd|eur|gbp|aud|cad|inr)\s?\d+(?:,\d{3})*(?:\.\d+)?)"
DATES = r"(?iU)(?:\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b)"
TABLE = r"\||\t|\s{3,}\S+\s{3,}"


def _led(pattern: str) -> str:
    """A pattern with the characters that a match begins with ahead of its word ends, which are dear to tell."""
    for start, first in ((r"\b\d", r"\d"), (r"\b(?:jan|", "[jfmasond][aepuco]"), (r"\b(?:usd|", "[uegaci][suban]")):
        pattern = pattern.replace(start, f"(?={first}){start}")
    return pattern


LABELS = ("editorial", "slight", "significant")


def _has(c, cues):
    """Whether lower-cased texts hold a cue."""
    out = F.lit(False)
    for cue in (cue for cue in cues if not any(other in cue for other in cues if other != cue)):  # "no" tells of "not" as well
        out = out | c.contains(cue)
    return out


def payload(diffs: DataFrame) -> DataFrame:
    """section_id, section_title, before_text, after_text and diff_score; empty counts as missing.  The status is the semantic one, where there is one."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    out = diffs.withColumn("section_title", F.coalesce(full("title_b"), full("title_a"), F.lit("")))
    out = out.withColumn("section_id", F.coalesce(full("section_id_b"), full("section_id_a"), F.lit("")))
    for s, name in (("a", "before_text"), ("b", "after_text")):
        out = out.withColumn(name, F.coalesce(full(f"semantic_text_{s}"), F.array_join(f"section_lines_{s}", "\n"), F.lit("")))
    score = next((c for c in ("match_score", "score") if c in diffs.columns), None)
    out = out.withColumn("diff_score", F.col(score).cast("double") if score else F.lit(None).cast("double"))
    if "semantic_status" in diffs.columns:
        status = F.coalesce(full("semantic_status"), F.col("status")) if "status" in diffs.columns else full("semantic_status")
        out = out.withColumn("status", status)
    return out


def value_features(rows: DataFrame) -> DataFrame:
    """The features that are sets, counts and tests of before_text and after_text: all inside the JVM."""
    a, b = F.col("before_text"), F.col("after_text")
    # most texts of a comparison are equal on both sides, and nothing is looked for in these
    same = F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
    for name, pattern in (("numeric_changes_count", NUMBERS), ("dates_changed", DATES), ("percentages_changed", PERCENTS), ("currency_changed", CURRENCIES)):
        rows = rows.withColumn(name, F.when(same, 0).otherwise(T.set_changes(T.found_in(a, _led(pattern)), T.found_in(b, _led(pattern)))))
    lower = lambda c: F.when(~same, F.lower(F.coalesce(c, F.lit(""))))
    rows = rows.withColumn("_low_a", lower(a)).withColumn("_low_b", lower(b))
    for name, cues in (("obligation_change", OBLIGATION), ("negation_change", NEGATION), ("scope_change_cues", SCOPE)):
        rows = rows.withColumn(name, ~same & (_has(F.col("_low_a"), cues) != _has(F.col("_low_b"), cues)))
    rows = rows.drop("_low_a", "_low_b")
    rows = rows.withColumn("table_change_detected", ~same & (F.coalesce(a, F.lit("")).rlike(TABLE) != F.coalesce(b, F.lit("")).rlike(TABLE)))
    rows = rows.withColumn("token_jaccard", F.when(same, 1.0).otherwise(T.jaccard(F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b)))))
    return rows.withColumn("sentence_overlap", F.when(same, 1.0).otherwise(T.jaccard(F.array_distinct(T.sentences(a)), F.array_distinct(T.sentences(b)))))


def features(rows: DataFrame, ratios: bool = True) -> DataFrame:
    """All features.  ratios: change_ratio of all rows; without, it is null where a hard signal decides, for those who want labels alone."""
    rows = value_features(rows)
    # equal texts do not leave the JVM
    asked, told = F.col("before_text") != F.col("after_text"), F.lit(True)
    if not ratios:
        told = F.size(hard_signals()) == 0
        asked = asked & told
    a, b = (F.when(asked, T.collapse(F.col(c))) for c in ("before_text", "after_text"))
    rows = rows.withColumn("change_ratio", F.when(told, change_ratio(a, b))).withColumn("_l", line_changes(F.col("before_text"), F.col("after_text")))
    return rows.withColumn("lines_added", F.col("_l.added")).withColumn("lines_removed", F.col("_l.removed")).withColumn("changed_pairs_count", F.col("_l.pairs")).drop("_l")


def hard_signals() -> F.Column:
    tests = [(n, F.col(n)) for n in ("obligation_change", "negation_change", "scope_change_cues")]
    counts = {"numeric_changes": "numeric_changes_count", "date_changes": "dates_changed", "percentage_changes": "percentages_changed", "currency_changes": "currency_changed"}
    tests += [(n, F.col(c) > 0) for n, c in counts.items()]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda s: s.isNotNull())


def ruled(rows: DataFrame) -> DataFrame:
    """rule_label, rule_confidence and triggered_rules."""
    rows = rows.withColumn("_hard", hard_signals())
    hard = F.size("_hard") > 0
    # fixed values: the thresholds and confidences of the rules
    alike = (F.col("change_ratio") <= 0.03) & (F.col("token_jaccard") >= 0.97) & (F.col("sentence_overlap") >= 0.95)
    large = (F.col("change_ratio") >= 0.45) | (F.col("token_jaccard") < 0.5)
    pick = lambda *v: F.when(hard, v[0]).when(alike, v[1]).when(large, v[2]).otherwise(v[3])
    rows = rows.withColumn("rule_label", pick(*map(F.lit, ("significant", "editorial", "significant", "slight"))))
    rows = rows.withColumn("rule_confidence", pick(*map(F.lit, (0.9, 0.88, 0.78, 0.7))))
    one = lambda s: F.array(F.lit(s))
    return rows.withColumn("triggered_rules", pick(F.col("_hard"), one("high_similarity_low_change_ratio"), one("large_change_surface"), one("default_small_semantic_change"))).drop("_hard")


Hook = Callable[[pd.DataFrame], pd.DataFrame]
Listener = Callable[[str, dict], None]

#: What a model is given of a row; columns that rows don't have are null.
ASKED = {"section_id": "string", "section_title": "string", "before_text": "string", "after_text": "string", "diff_score": "double", "status": "string", "anchor_type": "string", "low_confidence": "boolean"}
ANSWER = "struct<label:string,confidence:double,rationale:string,error:string>"
#: What counts where an answer says nothing.
CONFIDENCE, RATIONALE = 0.6, "Model classification."
#: Errors after which a model is asked again: of connections, times and answers that can't be read.
TRANSIENT = (OSError, TimeoutError, ValueError)


def read_answer(text: str) -> dict:
    """The object in a model's words: the whole text as JSON, or what its widest braces hold; empty if neither is one."""
    text = (text or "").strip()
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            told = json.loads(part)
        except ValueError:
            continue
        if isinstance(told, dict):
            return told
    return {}


def _told(answer: dict) -> dict:
    """label, confidence and rationale of an answer, as they count."""
    missing = lambda v: v is None or v is pd.NA or isinstance(v, float) and math.isnan(v)
    given = {k: v for k, v in answer.items() if not missing(v)}
    label = str(given.get("label", "slight")).strip().lower()
    confidence = max(0.0, min(1.0, float(given.get("confidence", CONFIDENCE))))
    return {"label": label if label in LABELS else "slight", "confidence": round(confidence, 4), "rationale": str(given.get("rationale", RATIONALE)), "error": None}


def _asking(hook: Hook, retries: int, wait: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Answers to a frame of ASKED; on failure row by row, again after longer and longer waits where the error is TRANSIENT."""
    import time

    def answer(frame: pd.DataFrame) -> list[dict]:
        got = hook(frame)
        if len(got) != len(frame):
            raise ValueError(f"{len(got)} answers to {len(frame)} rows")
        rows = got.to_dict("records")
        return [_told(read_answer(r["text"]) if "text" in r else r) for r in rows]

    def alone(row: pd.DataFrame) -> dict:
        for attempt in range(retries + 1):
            try:
                return answer(row)[0]
            except Exception as error:  # whatever a model raises must not end the job
                told = {"label": None, "confidence": None, "rationale": None, "error": str(error) or type(error).__name__}
                if attempt == retries or not isinstance(error, TRANSIENT):
                    return told
                time.sleep(wait * 2**attempt)

    def asked(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            rows = answer(frame)
        except Exception:  # the rows show which of them fail
            rows = [alone(frame.iloc[[k]]) for k in range(len(frame))]
        return pd.DataFrame(rows, columns=["label", "confidence", "rationale", "error"]).astype({"confidence": "float64"})

    return asked


def _given(rows: DataFrame) -> list[F.Column]:
    return [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in ASKED.items()]


def payload_key(rows: DataFrame, model: str, version: str) -> F.Column:
    """A hash of all that an answer depends on."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), F.lit(version).alias("version"), *_given(rows)), {"ignoreNullFields": "false"}), 256)


STORED = ["payload_key", "label", "confidence", "rationale", "model", "prompt_version"]


def answered(rows: DataFrame, hook: Hook, store: str, model: str, version: str, retries: int = 2, wait: float = 0.5, wave: int = 10_000, listener: Listener | None = None) -> DataFrame:
    """Rows with payload_key and ``_m`` (label, confidence, rationale, error), from a table of answers that outlives a run.

    Of payloads that are equal one is asked, and only those that the table at ``store``
    lacks (an anti-join).  They go in waves of some ``wave`` payloads, and each wave's
    answers are added to the table before the next begins: a run that was killed goes on where its last whole
    wave ended.  Failures are not stored, so that a later run asks again.

    listener: called on the driver with ``pre_llm`` before, and ``post_llm`` after each wave's rows,
    row by row, while later waves still wait; a wave bounds what it holds.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("payload_key", payload_key(rows, model, version))
    extra = [c for c in ("rule_label",) if c in rows.columns]
    wanted = rows.select("payload_key", *_given(rows), *extra).dropDuplicates(["payload_key"])
    if exists(spark, store):
        wanted = wanted.join(spark.read.parquet(store).select("payload_key"), "payload_key", "left_anti")
    wanted = written(wanted, "unanswered")
    waves = -(-wanted.count() // wave)
    failures = None
    ask = F.pandas_udf(_asking(hook, retries, wait), ANSWER)
    tell = lambda name, part, *columns: [listener(name, r.asDict()) for r in part.select("section_id", "section_title", *columns).toLocalIterator()] if listener else None
    for k in range(waves):
        part = wanted.filter(F.pmod(F.xxhash64("payload_key"), F.lit(waves)) == k)
        tell("pre_llm", part, *extra)
        got = written(part.withColumn("_m", ask(F.struct(*ASKED))).select("payload_key", "section_id", "section_title", "_m"), "asked")
        good = got.filter("_m.error is null").select("payload_key", "_m.label", "_m.confidence", "_m.rationale", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"))
        good.select(*STORED).write.mode("append").parquet(store)
        bad = got.filter("_m.error is not null").select("payload_key", F.col("_m.error").alias("error"))
        failures = bad if failures is None else failures.unionByName(bad)
        tell("post_llm", got, F.col("_m.label").alias("llm_label"), F.col("_m.error").isNotNull().alias("stub"))
    none = spark.createDataFrame([], "payload_key string, error string")
    kinds = "payload_key string, label string, confidence double, rationale string, model string, prompt_version string"
    known = spark.read.schema(kinds).parquet(store) if exists(spark, store) else spark.createDataFrame([], kinds)
    # two runs at once may both have asked: the least answer counts for all
    known = known.groupBy("payload_key").agg(F.min(F.struct("label", "confidence", "rationale")).alias("_a"))
    rows = rows.join(known, "payload_key", "left").join(none if failures is None else failures, "payload_key", "left")
    return rows.withColumn("_m", F.struct("_a.label", "_a.confidence", "_a.rationale", "error")).drop("_a", "error")


def modelled(rows: DataFrame, hook: Hook | None = None, retries: int = 2, wait: float = 0.5, version: str = "v1", model: str = "hook", store: str | None = None, wave: int = 10_000, listener: Listener | None = None) -> DataFrame:
    """model_label, model_confidence, model, prompt_version, rationale and stub (whether no model answered).

    hook: takes a frame of ASKED and returns one of label and, if it will, confidence and
    rationale, or one of ``text``: the model's words, with JSON in them.  It is called batch by batch on the
    executors.  If it fails on a batch, it is asked for each row alone, ``retries`` times
    more after longer and longer waits where the error is one of TRANSIENT; a row for
    which it still fails gets the stub's answer, so that no row is lost.

    Labels are trimmed and lower-cased, others than LABELS count as ``slight``; confidences lie
    in 0 to 1 and are CONFIDENCE if missing.  store, wave, listener: see :func:`answered`.

    Stub: the label ``slight`` at 0.51, or what the columns llm_mock_label and
    llm_mock_confidence say.
    """
    mock = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in rows.columns else F.lit(other)
    label, confidence = mock("llm_mock_label", "slight"), F.round(mock("llm_mock_confidence", 0.51).cast("double"), 4)
    if hook is None:
        rows = rows.withColumn("model_label", label).withColumn("model_confidence", confidence).withColumn("model", F.lit(None).cast("string"))
        return rows.withColumn("prompt_version", F.lit(f"{version}-stub")).withColumn("rationale", F.lit("no model is set")).withColumn("stub", F.lit(True))
    if store is not None:
        rows = answered(rows, hook, store, model, version, retries, wait, wave, listener)
    else:
        ask = F.pandas_udf(_asking(hook, retries, wait), ANSWER)
        rows = rows.withColumn("_m", ask(F.struct(*_given(rows))))
    failed = F.col("_m.label").isNull()
    rows = rows.withColumn("model_label", F.when(failed, label).otherwise(F.col("_m.label"))).withColumn("model_confidence", F.when(failed, confidence).otherwise(F.col("_m.confidence")))
    rows = rows.withColumn("model", F.lit(model)).withColumn("prompt_version", F.when(failed, f"{version}-fallback").otherwise(version)).withColumn("stub", failed)
    return rows.withColumn("rationale", F.when(failed, F.concat(F.lit("the model failed: "), F.col("_m.error"))).otherwise(F.col("_m.rationale"))).drop("_m")


def parse_label(text) -> F.Column:
    """label and confidence of an answer: the whole text as JSON, or its widest braces."""
    kind = "label string, confidence double"
    whole = F.from_json(text, kind)
    return F.when(whole["label"].isNotNull(), whole).otherwise(F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), kind))


def arbitrated(rows: DataFrame) -> DataFrame:
    """disagreement, hard_signal_flags, override_candidate and final_classification."""
    told = F.col("model_label").isNotNull() & (F.col("model_label") != "")
    rows = rows.withColumn("disagreement", told & (F.col("model_label") != F.col("rule_label")))
    values = F.greatest("numeric_changes_count", "dates_changed", "percentages_changed", "currency_changed") > 0
    rows = rows.withColumn("hard_signal_flags", F.struct("obligation_change", "negation_change", "scope_change_cues", values.alias("numeric_or_value_changes")))
    rows = rows.withColumn("override_candidate", F.when((F.size(hard_signals()) > 0) & F.col("model_label").isin("editorial", "slight"), F.lit("significant")))
    return rows.withColumn("final_classification", F.when(told, F.col("model_label")).otherwise(F.col("rule_label")))


def classified(diffs: DataFrame, hook: Hook | None = None, progress: Observation | None = None, ratios: bool = True, **adapter) -> DataFrame:
    """Features, rules, the model's answer and what counts of both.  ratios: see :func:`features`.  adapter: further arguments of :func:`modelled`.

    progress: told, once the rows have been written or counted, how many there are, how many a
    model answered and how many of each label came out, without another pass.
    """
    rows = arbitrated(modelled(ruled(features(payload(diffs), ratios)), hook, **adapter))
    if progress is None:
        return rows
    labels = [F.count_if(F.col("final_classification") == label).alias(label) for label in LABELS]
    return rows.observe(progress, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("stub")).alias("answered"), *labels)


def totals() -> dict[str, F.Column]:
    """The counts of classified rows, by name."""
    counts = {"total": F.count("*")} | {label: F.count_if(F.col("final_classification") == label) for label in LABELS} | {"disagreements": F.count_if("disagreement")}
    return {name: count.alias(name) for name, count in counts.items()}


def summary(rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Counts by pair; ``pairs``: also of those without any row."""
    return of_all(rows.groupBy("pair_id").agg(*totals().values()), pairs)
