"""Select / reject / undecide actions folded over duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.schemas import STATUSES


def validate_actions(actions: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C1. (actions that can be applied, errors). Unknown statuses, unknown or missing photos and files of registered sources are errors."""
    seen = photos.select(F.col("id").alias("photo_id"), "missing", F.col("relative_path").alias("_path"))
    joined = actions.join(seen, "photo_id", "left")
    error = (
        F.when(~F.col("status").isin(*STATUSES) | F.col("status").isNull(), "unknown status")
        .when(F.col("_path").isNull(), "unknown photo")
        .when(F.col("missing") | F.col("_path").startswith("@src/"), "conflict")
    )
    marked = joined.withColumn("error", error)
    return marked.filter("error is null").select(*actions.columns), marked.filter("error is not null").select(*actions.columns, "error")


def group_key() -> Column:
    """What photos decided together share: their hash, else the id alone."""
    sha = F.col("sha256")
    return F.when(F.coalesce(sha, F.lit("")) != "", sha).otherwise(F.concat(F.lit("id:"), F.col("id").cast("string")))


def fold_actions(photos: DataFrame, actions: DataFrame) -> DataFrame:
    """C2, C3. The catalog after all valid actions, with changed (true where the status differs from before).

    Whatever an action does, it rejects the other present members of its
    group, so only a group's last action counts: its photo takes that status,
    the others are rejected. Missing members and files of registered sources
    aren't carried along. original_path is set when a photo leaves "optional"
    for the first time; the origin of one that starts elsewhere is recorded by
    its move plan.
    """
    ok, _ = validate_actions(actions, photos)
    keyed = photos.withColumn("_k", group_key())
    acts = ok.join(keyed.select(F.col("id").alias("photo_id"), "_k", F.col("status").alias("_was")), "photo_id")
    order = F.struct("ts", "action_id")
    last = acts.groupBy("_k").agg(F.max_by(F.struct("photo_id", "status"), order).alias("_last"))
    left = acts.filter("status <> 'optional'").select(F.col("photo_id").alias("id"), F.lit(True).alias("_left")).distinct()
    joined = keyed.join(last, "_k", "left").join(left, "id", "left")
    actor = F.col("id") == F.col("_last.photo_id")
    follows = F.col("_last").isNotNull() & ~actor & ~F.col("missing") & ~F.col("relative_path").startswith("@src/")
    status = F.when(actor, F.col("_last.status")).when(follows, "rejected").otherwise(F.col("status"))
    departs = (F.col("status") == "optional") & (F.coalesce("_left", F.lit(False)) | follows) & (F.coalesce("original_path", F.lit("")) == "") & (F.col("source") == "local")
    new = {"status": status, "original_path": F.when(departs, F.col("relative_path")).otherwise(F.col("original_path"))}
    out = joined.withColumn("_new", status)
    return out.select(*(new[c].alias(c) if c in new else c for c in photos.columns), (F.col("_new") != F.col("status")).alias("changed"))


def fold_remote_actions(photos: DataFrame, decisions: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4. (catalog, decisions) after actions on remote rows; nothing cascades.

    A rejection is written to the account's decisions, undeciding deletes it,
    selecting changes the status alone.
    """
    remote = photos.filter("source = 'icloud'").select(F.col("id").alias("photo_id"), "account", "remote_id")
    acts = actions.filter(F.col("status").isin(*STATUSES)).join(remote, "photo_id")
    order = F.struct("ts", "action_id")
    last = acts.groupBy("photo_id").agg(F.max_by("status", order).alias("_s"))
    joined = photos.join(last.withColumnRenamed("photo_id", "id"), "id", "left")
    rows = joined.select(*(F.coalesce("_s", "status").alias(c) if c == "status" else c for c in photos.columns))
    written = acts.filter("status <> 'selected' and remote_id is not null").groupBy("account", "remote_id").agg(F.max_by("status", order).alias("status"))
    return rows, record_decisions(decisions, written, ["account", "remote_id"])


def record_decisions(decisions: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """C5. Decisions with the changes set; "optional" deletes a key. One change for each key."""
    kept = decisions.join(changes.select(*key), key, "left_anti")
    return kept.unionByName(changes.filter("status <> 'optional'").select(*decisions.columns))


def resolve_pairs(pairs: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C6. (pairs, actions, errors). keep_left selects a, then rejects b; keep_right the reverse; keep_both only resolves; defer does nothing.

    resolutions: action_id, ts, photo_a, photo_b, action. Of the two actions of
    a resolution the first gets the even number.
    """
    known = ("keep_left", "keep_right", "keep_both", "defer")
    errors = resolutions.filter(~F.col("action").isin(*known) | F.col("action").isNull()).withColumn("error", F.lit("unknown action"))
    fine = resolutions.filter(F.col("action").isin(*known)).join(pairs.select("photo_a", "photo_b"), ["photo_a", "photo_b"], "left_semi")
    act = lambda p, s, k: F.struct((F.col("action_id") * 2 + k).alias("action_id"), F.col("ts").alias("ts"), F.col(p).alias("photo_id"), F.lit(s).alias("status"))
    both = F.when(F.col("action") == "keep_left", F.array(act("photo_a", "selected", 0), act("photo_b", "rejected", 1))).when(F.col("action") == "keep_right", F.array(act("photo_b", "selected", 0), act("photo_a", "rejected", 1)))
    actions = fine.select(F.explode(both).alias("x")).select("x.*")
    done = fine.filter("action <> 'defer'").select("photo_a", "photo_b", F.lit(True).alias("_done")).distinct()
    joined = pairs.join(done, ["photo_a", "photo_b"], "left")
    return joined.select(*((F.col("resolved") | F.coalesce("_done", F.lit(False))).alias(c) if c == "resolved" else c for c in pairs.columns)), actions, errors


def apply_decisions(photos: DataFrame, decisions: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C7. Local rows are folded by group, remote rows one by one."""
    local = fold_actions(photos.filter("source = 'local'"), actions).drop("changed")
    remote, after = fold_remote_actions(photos.filter("source <> 'local'"), decisions, actions)
    return local.unionByName(remote), after
