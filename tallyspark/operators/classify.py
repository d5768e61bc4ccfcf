"""Labelling cases by cause: the rule table, the confidence gate, validation, callers' own providers, and resuming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.joins import running_sum
from tallyspark.schemas import (
    ACTION_CHARGEBACK,
    ACTION_DUPLICATE,
    ACTION_FEE,
    ACTION_HOLD,
    ACTION_LATE,
    ACTION_NORMAL,
    ACTION_OPEN,
    ACTION_REFUND,
    ACTION_SHORT,
    ACTION_STATUS,
    ACTION_UNEXPLAINED,
    CAUSES,
    CONFIDENCE_THRESHOLD,
    INSUFFICIENT,
    RECORD,
)
from tallyspark.sources import log
from tallyspark.sources.shared import stored

RULES_NAME, RULES_MODEL = "rules-baseline", "deterministic-rules-v1"


def _has(*codes: str) -> Column:
    return F.arrays_overlap("finding_types", F.array(*map(F.lit, codes)))


def _text(key: str) -> Column:
    return F.col("evidence")[key]


def _whole(key: str) -> Column:
    return _text(key).try_cast("bigint")


def _say(template: str, *keys: str) -> Column:
    """The template with {} filled from the evidence, ? where it is missing."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for key, rest in zip(keys, parts[1:]):
        out += [F.coalesce(_text(key), F.lit("?")), F.lit(rest)]
    return F.concat(*out)


def _verdict(cause: str, confidence: float, reasoning: Column, action: Column | str | None, amount: Column | None = None) -> Column:
    return F.struct(
        F.lit(cause).alias("cause"),
        F.lit(confidence).alias("confidence"),
        reasoning.alias("reasoning"),
        (F.lit(action) if not isinstance(action, Column) else action).cast("string").alias("action"),
        (F.lit(None) if amount is None else amount).cast("bigint").alias("amount_paise"),
    )


def rule_verdict(residue: DataFrame) -> DataFrame:
    """residue_id, cause, confidence, reasoning, action, amount_paise. The first rule that fits a case's finding codes decides.

    The reasoning cites the evidence in our words.
    """
    withheld = F.coalesce(_whole("withheld_paise"), _whole("expected_net_paise"), F.lit(0))
    fee_delta = F.coalesce(_whole("fee_delta_paise"), F.lit(0)) + F.coalesce(_whole("tax_delta_paise"), F.lit(0))
    days = F.coalesce(_whole("day_delta"), F.lit(0))
    orphan, delayed = _has("ORPHAN_SETTLEMENT_LINE"), _has("SETTLEMENT_DELAY")
    rules = [
        (_has("SETTLEMENT_ON_HOLD", "UNEXPECTED_BANK_CREDIT_ON_HOLD"), _verdict("ON_HOLD", 0.95, _say("Batch on hold: {} lines, net {} paise.", "line_count", "expected_net_paise"), ACTION_HOLD, withheld)),
        (_has("BANK_CREDIT_WITHOUT_SETTLEMENT"), _verdict("UNEXPLAINED", 0.9, _say("The bank credited {} paise under reference {}, which no settlement carries.", "credit_paise", "utr"), ACTION_UNEXPLAINED, _whole("credit_paise"))),
        (_has("ORDER_STATUS_CONTRADICTION"), _verdict("SILENT_UPI_FAIL", 0.9, _say("The order says {}, yet {} paise settled in {}.", "order_status", "settled_amount_paise", "settlement_id"), ACTION_STATUS)),
        (_has("SHORT_CAPTURE"), _verdict("PARTIAL_CAPTURE", 0.9, _say("{} of {} paise captured, {} short.", "captured_amount_paise", "order_amount_paise", "shortfall_paise"), ACTION_SHORT, _whole("shortfall_paise"))),
        (_has("FEE_SLAB_MISMATCH"), _verdict("FEE_VARIANCE", 0.9, _say("Fee at {} bp where the slab is {} bp: {} paise for {}.", "effective_bp", "slab_bp", "actual_fee_paise", "expected_fee_paise"), F.concat(F.lit(ACTION_FEE[0]), fee_delta.cast("string"), F.lit(ACTION_FEE[1])), fee_delta)),
        (orphan & (_text("line_type") == "adjustment"), _verdict("CHARGEBACK_DEBIT", 0.9, _say("An adjustment debits {} paise and names no order or payment.", "debit_paise"), ACTION_CHARGEBACK, _whole("debit_paise"))),
        (orphan & (_text("line_type") == "refund"), _verdict("REFUND_NETTED", 0.9, _say("A refund debits {} paise for payment {}, which has no line here.", "debit_paise", "missing_payment_id"), ACTION_REFUND)),
        (orphan, _verdict(INSUFFICIENT, 0.3, _say("A line of type {} belongs to no order.", "line_type"), None)),
        (_has("DUPLICATE_ORDER_PAIR"), _verdict("DUPLICATE_WEBHOOK", 0.85, _say("{} orders of {} paise within {} s, {} settled.", "orders_in_group", "amount_paise", "seconds_apart", "settled_orders"), ACTION_DUPLICATE)),
        (delayed & (days >= 4), _verdict("LATE_SETTLEMENT", 0.85, _say("Settled after {} days, {} more than expected.", "day_delta", "excess_days"), ACTION_LATE)),
        (delayed, _verdict(INSUFFICIENT, 0.3, _say("Settled after {} days: a capture past midnight would explain it.", "day_delta"), ACTION_NORMAL)),
        (_has("ORDER_WITHOUT_SETTLEMENT"), _verdict(INSUFFICIENT, 0.3, F.lit("Paid, no settlement line, no twin: nothing supports a cause."), ACTION_OPEN)),
    ]
    out = _verdict(INSUFFICIENT, 0.2, F.concat(F.lit("No rule for "), F.array_join("finding_types", ", ")), None)
    for fits, verdict in reversed(rules):
        out = F.when(F.coalesce(fits, F.lit(False)), verdict).otherwise(out)
    return residue.select("residue_id", out.alias("v")).select("residue_id", "v.*")


def _must_review(confidence: Column, cause: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return (confidence < threshold) | (cause == INSUFFICIENT)


def rules_classification(residue: DataFrame, latency_ms: int = 0) -> DataFrame:
    """Rule verdicts as classification records."""
    entry = F.when(F.col("action").isNotNull(), F.struct("action", "amount_paise"))
    call = F.struct("residue_id", F.col("cause").alias("predicted_cause"), "confidence", "reasoning", entry.alias("proposed_adjusting_entry"), _must_review(F.col("confidence"), F.col("cause")).alias("requires_human_review"))
    return rule_verdict(residue).select(
        "residue_id", F.lit(RULES_NAME).alias("provider"), F.lit(RULES_MODEL).alias("model"), F.lit("ok").alias("status"), F.lit(1).alias("attempts"), F.lit(False).alias("gate_forced_review"),
        F.array().cast("array<string>").alias("validation_errors"), F.lit(latency_ms).cast("bigint").alias("latency_ms"), call.alias("classification"),
    )


def confidence_gate(records: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Forces review below the threshold or without a cause; gate_forced_review tells whether the gate, not the provider, did."""
    c = F.col("classification")
    must = _must_review(c["confidence"], c["predicted_cause"], threshold)
    return records.withColumn("gate_forced_review", must & ~c["requires_human_review"]).withColumn("classification", c.withField("requires_human_review", c["requires_human_review"] | must))


def validate_classification(records: DataFrame) -> DataFrame:
    """The records with ``errors``: one text for each constraint that the classification breaks."""
    c = F.col("classification")
    entry = c["proposed_adjusting_entry"]
    checks = [
        (F.coalesce(F.length(c["residue_id"]), F.lit(0)) < 1, "residue_id: empty"),
        (~F.coalesce(c["predicted_cause"].isin([*CAUSES, INSUFFICIENT]), F.lit(False)), "predicted_cause: not a known cause"),
        (~F.coalesce(c["confidence"].between(0, 1), F.lit(False)), "confidence: not between 0 and 1"),
        (F.coalesce(F.length(c["reasoning"]), F.lit(0)) < 1, "reasoning: empty"),
        (entry.isNotNull() & (F.coalesce(F.length(entry["action"]), F.lit(0)) < 1), "proposed_adjusting_entry.action: empty"),
        (c["requires_human_review"].isNull(), "requires_human_review: missing"),
    ]
    return records.withColumn("errors", F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in checks))))


def case_lines(residue: DataFrame, entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """residue_id, section, place, text: findings, evidence, records by kind and near misses of each case, a row for each line. Sorted by section and place they read as a text."""
    line = lambda df, section, place, text: df.select("residue_id", F.lit(section).alias("section"), place.alias("place"), text.alias("text"))
    codes = residue.select("residue_id", F.explode("finding_types").alias("code"))
    facts = residue.select("residue_id", F.explode("evidence").alias("key", "value"))
    record = F.concat("kind", F.lit(" "), "id", F.lit(": "), F.regexp_replace("normalized", r'"[a-z_]+_ms":[^,}]+,?', ""))
    first = F.col("first")
    at = F.concat_ws(":", first["stage"], first["place"], F.lpad(first["rank"].cast("string"), 10, "0"), "kind", "id")
    out = line(codes, "1 FINDINGS", F.col("code"), F.col("code"))
    out = out.unionByName(line(facts, "2 EVIDENCE", F.col("key"), F.concat("key", F.lit(" = "), "value")))
    out = out.unionByName(line(entities, "3 RECORDS", F.concat_ws(":", "kind", "id"), record))
    why = F.concat("kind", F.lit(" "), "id", F.lit(": "), "reason")
    if "evidence" in candidates.columns:  # what made it near: amount, difference, reference, date
        shown = F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))
        why = F.concat(why, F.lit(" ("), F.array_join(shown, ", "), F.lit(")"))
    return out.unionByName(line(candidates, "4 NEAR MISSES", at, why))


def case_pages(residue: DataFrame, entities: DataFrame, candidates: DataFrame, rows: int = 200) -> DataFrame:
    """residue_id, page (from 1), text: all records and near misses of each case, so many to a page. Rows are numbered over range partitions, so a large case is many rows and tasks."""
    lines = case_lines(residue, entities, candidates).where("section >= '3'")
    at = running_sum(lines, F.lit(1), "residue_id", ["section", "place", "text"], "n").withColumn("page", F.ceil(F.col("n") / rows).cast("bigint"))
    line = F.concat(F.when(F.col("section") < "4", "  - ").otherwise("  ~ "), "text")
    return at.groupBy("residue_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def case_brief(residue: DataFrame, entities: DataFrame, candidates: DataFrame, rows: int = 200, details: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """residue_id, brief: findings, evidence, and number and amount of records and near misses by kind of each case as text.

    A case that fits on one page of case_pages has it at the end (records -, near misses ~); of a larger one the brief gives the
    number of pages, and case_pages has them all. So no row grows with its case, and cases are counted first: only records of those that
    fit are read and written out. ``details`` gives these records with their text, where ``entities`` has residue_id, kind, id and amount_paise alone.
    """
    def totals(df: DataFrame, amount: Column, name: str) -> DataFrame:
        kinds = df.groupBy("residue_id", "kind").agg(F.count("*").alias("n"), F.sum(amount).alias("paise"))
        text = F.concat(F.lit("  "), "kind", F.lit(": "), F.col("n").cast("string"), F.coalesce(F.concat(F.lit(", "), F.col("paise").cast("string"), F.lit(" paise")), F.lit("")))
        return kinds.groupBy("residue_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias(name))

    counts = stored(entities.select("residue_id").unionByName(candidates.select("residue_id")).groupBy("residue_id").agg(F.count("*").alias("n")))
    fits = counts.where(F.col("n") <= rows).select("residue_id")
    own = entities.join(fits, "residue_id", "left_semi")
    lines = stored(case_lines(residue, details(own) if details else own, candidates.join(fits, "residue_id", "left_semi")).where("section >= '3'"))
    text = lambda x: F.concat(F.when(x["section"] < "4", "  - ").otherwise("  ~ "), x["text"])
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "place", "text"))), text), "\n")
    told = F.concat(F.lit("  "), F.ceil(F.col("n") / rows).cast("string"), F.lit(" pages"))
    ends = lines.groupBy("residue_id").agg(page.alias("page")).unionByName(counts.where(F.col("n") > rows).select("residue_id", told.alias("page")))
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), e["value"])), "\n")
    both = residue.join(totals(entities, F.col("amount_paise"), "records"), "residue_id", "left").join(totals(candidates, F.lit(None).cast("bigint"), "near"), "residue_id", "left").join(ends, "residue_id", "left")
    none = F.lit("  (none)")
    parts = [F.concat(F.lit("CASE "), "residue_id"), F.lit("FINDINGS"), F.concat(F.lit("  "), F.array_join("finding_types", ", ")), F.lit("EVIDENCE"), facts]
    parts += [F.lit("RECORDS"), F.coalesce("records", none), F.lit("NEAR MISSES"), F.coalesce("near", none), F.lit("PAGES"), F.coalesce("page", none)]
    return both.select("residue_id", F.concat_ws("\n", *parts).alias("brief"))


def _problems(answer: object) -> list[str]:
    """What is wrong with a provider's answer."""
    if not isinstance(answer, dict):
        return ["(root): not an object"]
    out = []
    if answer.get("predicted_cause") not in [*CAUSES, INSUFFICIENT]:
        out.append("predicted_cause: not a known cause")
    confidence = answer.get("confidence")
    if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        out.append("confidence: not between 0 and 1")
    if not isinstance(answer.get("reasoning"), str) or not answer["reasoning"]:
        out.append("reasoning: empty")
    entry = answer.get("proposed_adjusting_entry")
    if entry is not None:
        if not isinstance(entry, dict) or not isinstance(entry.get("action"), str) or not entry["action"]:
            out.append("proposed_adjusting_entry.action: empty")
        elif entry.get("amount_paise") is not None and (isinstance(entry["amount_paise"], bool) or not isinstance(entry["amount_paise"], int)):
            out.append("proposed_adjusting_entry.amount_paise: not a whole number")
    if not isinstance(answer.get("requires_human_review"), bool):
        out.append("requires_human_review: missing")
    return out


def classify_with(briefs: DataFrame, provider: Callable[[str], dict], name: str, model: str, attempts: int = 2) -> DataFrame:
    """Classification records of a caller's function, called once for each case.

    An answer that breaks the schema is asked for again with the error added to the brief; after that, and when the call itself
    fails, a record that needs review is returned, so that one case never fails the job. Retried tasks call again: classify_logged commits
    records batch by batch and asks for no committed case.
    """

    def one(case: str, brief: str) -> str:
        began, errors, text = time.time(), [], brief
        record = {"residue_id": case, "provider": name, "model": model, "gate_forced_review": True}
        fallback = {"residue_id": case, "predicted_cause": INSUFFICIENT, "confidence": 0.0, "proposed_adjusting_entry": None, "requires_human_review": True}
        status, answer, tried = "schema_failure", None, 0
        while tried < attempts:
            tried += 1
            try:
                answer = provider(text)
            except Exception as e:  # the provider's, whatever it is
                errors.append(str(e))
                status = "transport_failure"
                break
            wrong = _problems(answer)
            if not wrong:
                status = "ok" if tried == 1 else "repaired"
                break
            errors.append("; ".join(wrong))
            text = f"{brief}\n\nThe last answer broke the schema: {errors[-1]}"
        if status in ("ok", "repaired"):
            must = answer["confidence"] < CONFIDENCE_THRESHOLD or answer["predicted_cause"] == INSUFFICIENT
            record["gate_forced_review"] = must and not answer["requires_human_review"]
            call = {k: answer.get(k) for k in fallback} | {"reasoning": answer["reasoning"], "residue_id": case, "requires_human_review": must or answer["requires_human_review"]}
        else:
            call = fallback | {"reasoning": f"{status}: {errors[-1]}"}
        return json.dumps(record | {"status": status, "attempts": tried, "validation_errors": errors, "latency_ms": round(1000 * (time.time() - began)), "classification": call})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"line": [one(c, t) for c, t in zip(b["residue_id"], b["brief"])]})

    lines = briefs.select("residue_id", "brief").mapInPandas(each, "line string")
    return lines.select(F.from_json("line", RECORD).alias("r")).select("r.*")


def classify_logged(briefs: DataFrame, provider: Callable[[str], dict], name: str, model: str, path: str, batches: int = 16, retry_failed: bool = False) -> DataFrame:
    """classify_with through a log (sources.log): cases are asked in batches, dealt by a hash of their id, each one commit; gives the last record of every case.

    Cases with a committed record aren't asked again, so a run that breaks off, or a task that is lost, costs the calls of the batch it was in and no more.
    Records of another provider or model are refused before anything is asked.
    """
    spark = briefs.sparkSession
    log.claim(spark, path)  # so that there is a folder to read
    for k in range(batches):
        done = log.latest(log.read(spark, path, RECORD, "residue_id")[0], "residue_id")
        if k == 0:
            assert_single_provider(done, name, model)
        pending = pending_cases(briefs, done, retry_failed).where(F.pmod(F.xxhash64("residue_id"), F.lit(batches)) == k)
        if not pending.isEmpty():
            log.append(classify_with(pending, provider, name, model), path, "residue_id")
    return log.latest(log.read(spark, path, RECORD, "residue_id")[0], "residue_id").drop("commit", "ordinal")


def _resumable(retry_failed: bool) -> Column:
    return (F.col("status") != "transport_failure") & (F.lit(not retry_failed) | (F.col("status") != "schema_failure"))


def pending_cases(residue: DataFrame, completed: DataFrame, retry_failed: bool = False, fresh: bool = False) -> DataFrame:
    """The cases still to be classified."""
    return residue if fresh else residue.join(completed.where(_resumable(retry_failed)).select("residue_id"), "residue_id", "left_anti")


def assert_single_provider(completed: DataFrame, provider: str, model: str) -> None:
    """Refuses records of another provider or model. What is listed is one row for each such pair."""
    others = completed.where((F.col("provider") != provider) | (F.col("model") != model)).groupBy("provider", "model").agg(F.count("*").alias("n")).orderBy("provider", "model").collect()
    if others:
        raise ValueError("records of another provider: " + ", ".join(f"{r.provider}/{r.model} ({r.n})" for r in others))


def compact_classifications(completed: DataFrame, retry_failed: bool = False, order: str = "seq") -> DataFrame:
    """One record for each case, the last by ``order``, without those that have to be done again."""
    last = completed.groupBy("residue_id").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
    return last.where(_resumable(retry_failed))


def ambiguity_rank(residue: DataFrame, limit: int | None = None) -> DataFrame:
    """Cases, hardest first: several codes 3, a delay of three days or less 2, an orphan line 1, an unsettled order 1."""
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    rank = yes(F.size("finding_types") > 1, 3) + yes(_has("SETTLEMENT_DELAY") & (_whole("day_delta") <= 3), 2) + yes(_has("ORPHAN_SETTLEMENT_LINE"), 1) + yes(_has("ORDER_WITHOUT_SETTLEMENT"), 1)
    out = residue.withColumn("rank", rank).orderBy(F.desc("rank"), "residue_id")
    return out if limit is None else out.limit(limit)


def classification_summary(records: DataFrame) -> DataFrame:
    """measure, key, n: records by status and by cause, sent to review, approved, forced by the gate."""
    c = F.col("classification")
    facts = F.array(
        F.struct(F.lit("status").alias("measure"), F.col("status").alias("key")),
        F.struct(F.lit("cause").alias("measure"), c["predicted_cause"].alias("key")),
        F.struct(F.lit("review").alias("measure"), c["requires_human_review"].cast("string").alias("key")),
        F.struct(F.lit("gate_forced").alias("measure"), F.col("gate_forced_review").cast("string").alias("key")),
    )
    return records.select(F.explode(facts).alias("f")).groupBy("f.measure", "f.key").agg(F.count("*").alias("n"))
