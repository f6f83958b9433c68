"""File formats of the store: JSON Lines transcripts in, numbered chunks and Markdown vaults out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.windows import numbered_chunks

#: A user's text with one of these is a command's.
COMMAND_MARKS = ("<command-name>", "<command-message>", "<local-command-stdout>")
#: Lines from a transcript's end in which its last answer is looked for.
LAST_LINES = 50


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, entry, malformed): the lines of JSON Lines transcripts in order of ``at`` within their file; blank lines are left out, entry is null where a line is no JSON."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), F.btrim("value").alias("value"))
    entry = F.try_parse_json("value")
    return lines.where("value != ''").select("file", "at", entry.alias("entry"), entry.isNull().alias("malformed"))


def _field(name: str):
    """A field of the entry if it is a text that isn't blank."""
    v = F.try_variant_get("entry", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.btrim(F.try_variant_get("entry", f"$.{name}", "string")), F.lit("")))


def _said(role: str):
    """The text of an entry of the role: its message's content or its own, a text or the texts of its parts."""
    inner = F.try_variant_get("entry", "$.message.content", "variant")
    content = F.coalesce(inner, F.try_variant_get("entry", "$.content", "variant"))
    parts = F.try_variant_get(content, "$", "array<variant>")
    kind = lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("text"))
    shown = lambda p: F.try_variant_get(p, "$.text", "string")
    # Of an answer only the parts that are texts; of a user also what tools have returned.
    text = lambda p: F.when(kind(p) == "text", shown(p)) if role == "assistant" else F.coalesce(shown(p), F.try_variant_get(p, "$.content", "string"))
    listed = F.array_join(F.filter(F.transform(parts, text), lambda x: F.coalesce(F.btrim(x) != "", F.lit(False))), "\n")
    whole = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(listed)
    by = F.coalesce(_field("message.role"), _field("role"), _field("type"))
    return F.when(by == role, F.nullif(F.btrim(whole), F.lit("")))


def transcript_ends(rows: DataFrame) -> DataFrame:
    """(file, session_id, user_text, user_source, assistant_text, last_answer, status, lines, malformed) of each transcript.

    The first user text is a queued prompt if there is one, else the first message of the user (a command's if
    it holds a mark of one); the session is the one that the queued prompt names, else the first named.  last_answer is the last answer within LAST_LINES lines of the end.  status:
    complete, abandoned-before-assistant or missing.
    """
    queued = (_field("type") == "queue-operation") & (_field("operation") == "enqueue")
    named = lambda *fields: F.coalesce(*[_field(f) for f in fields])
    r = rows.select("file", "at", "malformed", F.when(F.coalesce(queued, F.lit(False)), named("content", "prompt", "message")).alias("queued"), _said("user").alias("asked"), _said("assistant").alias("answer"), named("sessionId", "session_id", "sessionKey", "session_key").alias("session"), named("sessionId", "session_id", "sessionKey").alias("own_session"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    ends = r.groupBy("file").agg(
        first("queued").alias("q"), first("asked").alias("u"), first("answer").alias("assistant_text"), F.max(F.when(F.col("answer").isNotNull(), F.col("at"))).alias("last_at"), F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("at"))).alias("last"),
        first("session").alias("s"), F.min_by("own_session", F.when(F.col("queued").isNotNull(), F.col("at"))).alias("qs"), F.count_if(~F.col("malformed")).alias("lines"), F.count_if("malformed").alias("malformed"),
    )
    # How many good lines come after the last answer.
    after = r.where("NOT malformed").join(ends.select("file", "last_at"), "file").where("at > last_at").groupBy("file").agg(F.count(F.lit(1)).alias("after"))
    e = ends.join(after, "file", "left")
    marked = F.lit(False)
    for m in COMMAND_MARKS:
        marked = marked | F.contains("u", F.lit(m))
    user = F.coalesce("q", "u")
    status = F.when(user.isNotNull() & F.col("assistant_text").isNotNull(), "complete").when(user.isNotNull(), "abandoned-before-assistant").otherwise("missing")
    source = F.when(F.col("q").isNotNull(), "queue-operation").when(F.col("u").isNotNull(), F.when(marked, "user-string-cmd").otherwise("user-message"))
    return e.select("file", F.when(F.col("q").isNotNull(), F.coalesce("qs", "s")).otherwise(F.col("s")).alias("session_id"), user.alias("user_text"), source.alias("user_source"), "assistant_text", F.when(F.coalesce("after", F.lit(0)) < LAST_LINES, F.col("last")).alias("last_answer"), status.alias("status"), "lines", "malformed")


def import_chunks(chunks: DataFrame, path: str, now_ms: int) -> None:
    """Append chunks (kb_id, content) to a stored table, a folder for each base: blank ones are left out, vectors are still to come, tokens are estimated in the same pass."""
    rows = chunks.where(T.trim(F.col("content")) != "").select("kb_id", "content", F.lit(None).cast("array<double>").alias("embedding"), T.token_estimate(F.col("content")).alias("tokens"), F.lit(now_ms).cast("long").alias("imported_ms"))
    rows.write.mode("append").partitionBy("kb_id").parquet(path)


def path_category(path):
    """Category of an exported file by its place, first rule that matches."""
    rules = (("/episodes/", "podcast-episodes"), ("/social-posts/", "social-posts"), ("/lookup/", "lookup-indexes"), ("zoom-call", "zoom-calls"))
    out = F.when(F.startswith(path, F.lit("memory/clients/")), "client-notes")
    for part, name in rules:
        out = out.when(F.contains(path, F.lit(part)), name)
    return out.when(F.startswith(path, F.lit("memory/2026-")) | (path == "MEMORY.md"), "daily-memory").otherwise("other")


def file_id(path):
    """The file's name without .md."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.md$", "")


def export_chunks(rows: DataFrame, out: str) -> None:
    """rows (path, start_line, content) as JSON, numbered within their file, a folder for each category."""
    n = numbered_chunks(rows, "path", "start_line")
    n = n.withColumn("title", F.concat(file_id(F.col("path")), F.lit(" — Chunk "), F.col("chunk_no").cast("string"), F.lit("/"), F.col("chunks").cast("string")))
    n.withColumn("category", path_category(F.col("path"))).write.partitionBy("category").json(out)


def vault_rows(memories: DataFrame) -> DataFrame:
    """(store, file, body): a Markdown file with front matter for each memory."""
    head = F.concat(F.lit("---\nstore: "), F.col("store"), F.lit("\ncategory: "), F.col("category"), F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n"))
    return memories.select("store", F.concat(F.lit("memory-"), F.col("memory_id").cast("string"), F.lit(".md")).alias("file"), F.concat(head, F.col("content")).alias("body"))


def write_vault(memories: DataFrame, out: str) -> None:
    """The vault as Parquet rows by store; one task writes many files' bodies, so a vault of any size is a bounded number of objects."""
    vault_rows(memories).write.partitionBy("store").parquet(out)
