"""What reviewers said about the graph."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boscograph.sources import store

SCHEMA = (
    "feedback_id string, feedback_type string, timestamp string, user_id string, item_id bigint, comment string, "
    "data struct<original: struct<node_1: string, node_2: string, relation_type: string>, correction: struct<correct_direction: string, corrected_node_1: string, corrected_node_2: string>, "
    "node_1: string, node_2: string, wrong_relation: string, correct_relation: string, entity_1: string, entity_2: string, canonical_name: string, relation_type: string>, received_at timestamp"
)


def once(feedback: DataFrame) -> DataFrame:
    """Each feedback_id once, as it first arrived; a group-by of whole rows combined before the shuffle."""
    row = F.struct(*feedback.columns)
    first = feedback.where("feedback_id is not null").groupBy("feedback_id").agg(F.min_by(row, F.struct("received_at", F.to_json(row))).alias("r"))
    return first.select("r.*")


def report(feedback: DataFrame) -> DataFrame:
    """part (total, type, user), key, n."""
    total = feedback.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit("").alias("key"), "n")
    by = [feedback.groupBy(F.coalesce(c, F.lit("")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "key", "n") for p, c in (("type", "feedback_type"), ("user", "user_id"))]
    return total.unionByName(by[0]).unionByName(by[1])


def patterns(feedback: DataFrame) -> DataFrame:
    """kind, pattern, n: relation types whose direction was wrong, and wrong → right types."""
    d = feedback.where("feedback_type = 'relation_direction_error' and data.original.relation_type is not null").groupBy(F.col("data.original.relation_type").alias("pattern")).agg(F.count("*").alias("n"))
    t = feedback.where("feedback_type = 'relation_type_error' and data.wrong_relation is not null and data.correct_relation is not null")
    t = t.groupBy(F.concat("data.wrong_relation", F.lit(" → "), "data.correct_relation").alias("pattern")).agg(F.count("*").alias("n"))
    return d.select(F.lit("direction").alias("kind"), "pattern", "n").unionByName(t.select(F.lit("type").alias("kind"), "pattern", "n"))


def training_pairs(feedback: DataFrame) -> DataFrame:
    """feedback_id, feedback_type, input, output of the three kinds that teach something; rows with a missing part are left out."""
    f = F.format_string
    c = F.col
    given = (
        F.when(c("feedback_type") == "relation_direction_error", F.struct(f("关系: %s → %s → %s", c("data.original.node_1"), c("data.original.relation_type"), c("data.original.node_2")).alias("i"), f("正确方向: %s → %s → %s", c("data.correction.corrected_node_1"), c("data.original.relation_type"), c("data.correction.corrected_node_2")).alias("o")))
        .when(c("feedback_type") == "relation_type_error", F.struct(f("关系: %s → %s → %s", c("data.node_1"), c("data.wrong_relation"), c("data.node_2")).alias("i"), f("正确关系: %s → %s → %s", c("data.node_1"), c("data.correct_relation"), c("data.node_2")).alias("o")))
        .when(c("feedback_type") == "entity_merge", F.struct(f("实体: %s, %s", c("data.entity_1"), c("data.entity_2")).alias("i"), f("应合并为: %s", c("data.canonical_name")).alias("o")))
    )
    full = (
        F.when(c("feedback_type") == "relation_direction_error", c("data.original.node_1").isNotNull() & c("data.original.relation_type").isNotNull() & c("data.original.node_2").isNotNull() & c("data.correction.corrected_node_1").isNotNull() & c("data.correction.corrected_node_2").isNotNull())
        .when(c("feedback_type") == "relation_type_error", c("data.node_1").isNotNull() & c("data.node_2").isNotNull() & c("data.wrong_relation").isNotNull() & c("data.correct_relation").isNotNull())
        .when(c("feedback_type") == "entity_merge", c("data.entity_1").isNotNull() & c("data.entity_2").isNotNull() & c("data.canonical_name").isNotNull())
    )
    return feedback.where(full).select("feedback_id", "feedback_type", given.i.alias("input"), given.o.alias("output"))


def recent(feedback: DataFrame, n: int = 10) -> DataFrame:
    return feedback.orderBy(F.desc("timestamp"), "feedback_id").limit(n)


#: What a report of each kind must name.
PARTS = {
    "relation_direction_error": ("node_1", "node_2", "relation_type", "correct_direction"),
    "relation_type_error": ("node_1", "node_2", "wrong_relation", "correct_relation"),
    "entity_merge": ("entity_1", "entity_2", "canonical_name"),
    "missing_relation": ("node_1", "node_2", "relation_type"),
}


def reported(spark: SparkSession, reports: list[dict]) -> DataFrame:
    """Feedback rows of reports, dicts with feedback_type, the parts of its kind, and user_id (by default anonymous), comment, item_id where they are known.

    Each has an id and a time of its own. Of a direction error the corrected nodes are those given, swapped if correct_direction is `reverse`. An unknown kind or a missing part is an error.
    """
    rows = []
    for r in reports:
        kind = r.get("feedback_type")
        if kind not in PARTS:
            raise ValueError(f"unknown kind of feedback: {kind}")
        missing = [p for p in PARTS[kind] if r.get(p) is None]
        if missing:
            raise ValueError(f"{kind} without {', '.join(missing)}")
        data = {p: r[p] for p in PARTS[kind]}
        if kind == "relation_direction_error":
            ends = (r["node_1"], r["node_2"])
            first, second = ends[::-1] if r["correct_direction"] == "reverse" else ends
            data = {"original": {p: r[p] for p in ("node_1", "node_2", "relation_type")}, "correction": {"correct_direction": r["correct_direction"], "corrected_node_1": first, "corrected_node_2": second}}
        now = datetime.now(timezone.utc)
        rows.append({"feedback_id": f"fb_{uuid.uuid4().hex}", "feedback_type": kind, "timestamp": now.replace(tzinfo=None).isoformat(), "user_id": r.get("user_id") or "anonymous", "item_id": r.get("item_id"), "comment": r.get("comment") or "", "data": data, "received_at": now})
    return spark.createDataFrame(rows, SCHEMA)


def record(spark: SparkSession, path: str, reports: list[dict]) -> list[str]:
    """Appends reports to the JSON lines under path; returns their ids."""
    rows = reported(spark, reports).coalesce(1).collect()
    store.append_json_lines(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    return [r["feedback_id"] for r in rows]


def merges(feedback: DataFrame) -> DataFrame:
    """entity_1, entity_2, canonical_name, n of the merges asked for."""
    return feedback.where("feedback_type = 'entity_merge'").groupBy("data.entity_1", "data.entity_2", "data.canonical_name").agg(F.count("*").alias("n"))
