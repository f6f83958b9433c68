"""Clean-up of messages that hold recalled context: a plan, its counters, and its application to a stored table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.common import checkpoint
from mnemospark.operators.content import stripped

#: Longest content that is kept, and what marks a cleaned row.
MOST_CHARS, MARK = 8000, "recalled_context_cleanup:"
#: What two messages share if one repeats the other; nulls are equal.
_KEY = ["user_id", "role", "channel", "session_key", "turn_id", "turn_index"]


def cleanup_plan(messages: DataFrame, scope: DataFrame | None = None, apply: bool = True) -> DataFrame:
    """(message_id, user_id, action, malformed, original_chars, cleaned_chars, content, content_hash): what is done with users' messages that begin with recalled context.

    delete: the block doesn't end, or nothing follows it.  merge-delete: what follows is
    the text of another message of the same user, role, channel, session and turn.  patch: all
    else; content is what follows.  With ``apply`` rows are gone through from the newest,
    so of equal cleaned ones the newest is patched and the others are merged into it; without, each is
    only held against the rows as they are.

    ``scope`` has the message_id of rows that may be changed (all if None; see
    ``capture.in_cleanup_scope``); all of ``messages`` are looked at for repeats.
    A ``content_hash`` column of messages is used if there, else computed.
    """
    users = messages.where("role = 'user'")
    own = users if scope is None else users.join(scope.select("message_id"), "message_id", "left_semi")
    found = own.withColumn("said", stripped(F.col("content"))).where("said.malformed OR said.dropped > 0")
    cleaned = F.substring(F.col("said.content"), 1, MOST_CHARS)
    rows = found.select("message_id", *_KEY, "ts", F.col("said.malformed").alias("malformed"), F.length("content").alias("original_chars"), F.length(T.trim(cleaned)).alias("cleaned_chars"), cleaned.alias("content"))
    rows = checkpoint(rows.withColumn("content_hash", T.message_hash(F.col("role"), F.col("content"))))
    dead = rows.where("malformed OR cleaned_chars = 0").withColumn("action", F.lit("delete"))
    live = rows.where("NOT malformed AND cleaned_chars > 0")

    def same(a: str, b: str):
        on = F.col(f"{a}.content_hash") == F.col(f"{b}.content_hash")
        for c in _KEY:
            on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return on

    hashed = users if "content_hash" in messages.columns else users.withColumn("content_hash", T.message_hash(F.col("role"), F.col("content")))
    rest = hashed.select("message_id", "content_hash", *_KEY).join(rows.select("message_id"), "message_id", "left_anti")
    # A copy of each key that cleaned rows want and other rows have.
    wanted = live.select("content_hash", *_KEY).distinct()
    taken = rest.alias("r").join(wanted.alias("w"), same("r", "w"), "left_semi").select("content_hash", *_KEY).distinct()
    newest = live.groupBy("content_hash", *_KEY).agg(F.max(F.struct("ts", "message_id")).alias("newest"))
    newest = newest.alias("n").join(taken.withColumn("stored", F.lit(True)).alias("t"), same("n", "t"), "left").select("n.*", F.coalesce("t.stored", F.lit(False)).alias("stored"))
    repeats = F.col("k.stored")
    if apply:
        repeats = repeats | (F.col("k.newest.message_id") != F.col("l.message_id"))
    live = live.alias("l").join(newest.alias("k"), same("l", "k")).select("l.*", F.when(repeats, "merge-delete").otherwise("patch").alias("action"))
    cols = ["message_id", "user_id", "action", "malformed", "original_chars", "cleaned_chars", F.when(F.col("action") == "patch", F.col("content")).alias("content"), F.when(F.col("action") == "patch", F.col("content_hash")).alias("content_hash")]
    return dead.select(*cols).unionByName(live.select(*cols))


def counters(plan: DataFrame, apply: bool = True) -> DataFrame:
    """(user_id, candidates, would_patch, patched, would_delete, deleted, would_merge_delete, merged_deleted, malformed) of a plan."""
    n = {k: F.count_if(F.col("action") == a) for k, a in (("patch", "patch"), ("delete", "delete"), ("merge_delete", "merge-delete"))}
    done = {k: v if apply else F.lit(0).cast("long") for k, v in n.items()}
    return plan.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("candidates"), n["patch"].alias("would_patch"), done["patch"].alias("patched"), n["delete"].alias("would_delete"), done["delete"].alias("deleted"), n["merge_delete"].alias("would_merge_delete"), done["merge_delete"].alias("merged_deleted"), F.count_if("malformed").alias("malformed")
    )


def samples(plan: DataFrame, messages: DataFrame, n: int = 10) -> DataFrame:
    """The newest n rows of a plan for each user, as a report shows them."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("message_id"))
    own = plan.drop("content", "content_hash").join(messages.select("message_id", "channel", "session_key", "ts"), "message_id")
    return own.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def apply_plan(spark: SparkSession, path: str, plan: DataFrame, partition: str, now_ms: int) -> list:
    """Carry out a plan on a Parquet table partitioned by ``partition``; the values of the partitions that were written anew.

    Only partitions with planned rows are read and overwritten.  Their new rows are
    complete in the checkpoint folder before anything is overwritten, so a lost executor costs no row; a partition
    that loses all rows is removed.  Patched rows get content and content_hash and are
    marked in ``metadata``; embedded and extracted_at are reset, where the table has these columns.
    """
    table = spark.read.parquet(path)
    marks = plan.select("message_id", "action", F.col("content").alias("__content"), F.col("content_hash").alias("__hash"))
    touched = [r[0] for r in table.select("message_id", partition).join(marks.select("message_id"), "message_id", "left_semi").select(partition).distinct().collect()]  # partitions of the table
    if not touched:
        return []
    named = [v for v in touched if v is not None]
    here = F.col(partition).isin(named) if named else F.lit(False)
    here = here | F.col(partition).isNull() if None in touched else here
    old = table.where(here)
    folders = {r.value: r.folder for r in old.groupBy(F.col(partition).alias("value")).agg(F.first(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).alias("folder")).collect()}
    patch = F.coalesce(F.col("action") == "patch", F.lit(False))
    note = F.concat(F.lit(MARK), F.lit(str(now_ms)))
    told = T.trim(F.col("metadata")) if "metadata" in table.columns else None
    new = {
        "content": F.col("__content"),
        "content_hash": F.col("__hash"),
        "embedded": F.lit(False),
        "extracted_at": F.lit(None),
        "metadata": None if told is None else F.when(told == "", note).when(F.contains(told, F.lit(MARK)), told).otherwise(F.concat(told, F.lit("; "), note)),
    }
    kinds = dict(table.dtypes)
    changed = old.join(marks, "message_id", "left").where(F.col("action").isNull() | (F.col("action") == "patch"))
    changed = checkpoint(changed.select(*[F.when(patch, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns]))
    left = {r[0] for r in changed.select(partition).distinct().collect()}
    changed.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for value in set(touched) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(folders[value])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints."""
    checkpoint(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
