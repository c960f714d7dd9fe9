"""Chat history and sessions as batch queries over message and session-event tables.

Messages are (session_id, role, text, ts, ...). A session may hold a large share of all
messages, so every per-session step first keeps only rows that can matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import SPACE, strip
from marlstone.operators.ranking import top_k

# Spoken roles, words that refer to a document, image addresses, titles.
ROLE_NAMES = {"user": "用户", "assistant": "助手"}
REFERENCE_WORDS = r"(?:这篇|这份|这个|该文档|该论文|它)"
IMAGE_URL = (
    r'(?i)https?://[^\s<>"\]\)]+\.(?:png|jpe?g|gif|webp|bmp|svg)(?:\?[^\s<>"\]\)]*)?'
)
DEFAULT_SESSION_TITLE = "新会话"
TITLE_CHARS = 20


def recent_messages(messages: DataFrame, limit: int = 10, order: str = "ts") -> DataFrame:
    """Newest ``limit`` messages of every session, ``rank`` 1 being the newest."""
    return top_k(messages, ["session_id"], _newest(order), limit)


def _newest(order: str) -> list[Column]:
    """Newest first; messages of one time by a hash of what they say, so that reruns agree."""
    return [F.col(order).desc(), F.xxhash64("role", "text")]


def exchange_rows(answers: DataFrame) -> DataFrame:
    """Messages to append for answered questions: the user's, then the assistant's.

    ``answers`` is (session_id, question, answer, asked_at, answered_at[, selected_documents]).
    """
    have = "selected_documents" in answers.columns
    documents = F.col("selected_documents") if have else F.array().cast("array<string>")
    row = lambda role, text, ts: F.struct(
        F.lit(role).alias("role"), F.col(text).alias("text"), F.col(ts).alias("ts"), documents.alias("selected_documents")
    )
    both = F.array(row("user", "question", "asked_at"), row("assistant", "answer", "answered_at"))
    return answers.select("session_id", F.inline(both)).where(F.length(F.coalesce("text", F.lit(""))) > 0)


def session_list(sessions: DataFrame, owner_id: str, limit: int = 50) -> DataFrame:
    """An owner's sessions, most recently used first; the limit is kept within 1..200."""
    return (
        sessions.where(F.col("owner_id") == owner_id)
        .orderBy(F.col("updated_at").desc(), F.col("session_id"))
        .limit(min(max(limit, 1), 200))
    )


def budgeted_history(
    messages: DataFrame, budget: Column | int, order: str = "ts"
) -> DataFrame:
    """Newest messages of each session within a character budget, joined oldest first.

    The message crossing the budget is cut. ``budget`` is a number or a per-session column. A line takes at least the role name, a colon, one character and
    a separator, so only so many newest lines can fit; older ones are dropped, before the
    shuffle, whatever the length of a session.
    """
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    limit = F.lit(budget) if isinstance(budget, int) else budget
    largest = budget if isinstance(budget, int) else messages.agg(F.max(budget)).first()[0] or 0
    spoken = messages.where(F.col("role").isin(*ROLE_NAMES) & (F.length(text) > 0)).select(
        "session_id", order, "role", "text", F.concat(names[F.col("role")], F.lit("："), text).alias("line"), limit.alias("budget")
    )
    shortest = min(len(n) for n in ROLE_NAMES.values()) + 3
    most = int(largest) // shortest + 2
    spoken = top_k(spoken, ["session_id"], _newest(order), most, "age")
    before = Window.partitionBy("session_id").orderBy("age").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    room = spoken.withColumn("room", F.col("budget") - used)
    kept = room.where(F.col("room") > 0).withColumn("line", F.substring(F.col("line"), F.lit(1), F.col("room").cast("int")))
    lines = F.sort_array(F.collect_list(F.struct("age", "line")), asc=False)
    return kept.groupBy("session_id").agg(
        F.array_join(F.transform(lines, lambda m: m["line"]), "\n").alias("history"),
        F.count(F.lit(1)).alias("messages"),
    )


def transcript(messages: DataFrame, limit: int = 10, order: str = "ts") -> DataFrame:
    """The newest messages of each session as 'role: text' lines, oldest first."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    recent = recent_messages(messages, limit, order).withColumn("t", text).where(F.length("t") > 0)
    line = F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), F.col("t"))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))), asc=False)
    return recent.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda m: m["line"]), "\n").alias("transcript"))


def referred_documents(questions: DataFrame, messages: DataFrame, order: str = "ts") -> DataFrame:
    """(query_id, documents): what a referring word points to, the latest message having any.

    ``questions`` is (query_id, session_id, text); ``messages`` carries
    ``selected_documents``, an array.
    """
    latest = messages.where(F.size("selected_documents") > 0).groupBy("session_id").agg(
        F.max_by("selected_documents", order).alias("documents")
    )
    return questions.where(F.col("text").rlike(REFERENCE_WORDS)).join(latest, "session_id").select("query_id", "documents")


def image_urls(text: Column) -> Column:
    """Distinct image addresses in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IMAGE_URL), F.lit(0)))


def visible_history(messages: DataFrame, limit: int = 50, order: str = "ts") -> DataFrame:
    """User and assistant messages among the newest ones, with their image addresses."""
    recent = recent_messages(messages, limit, order).where(F.col("role").isin(*ROLE_NAMES))
    return recent.select("session_id", "role", "text", order, image_urls(F.coalesce("text", F.lit(""))).alias("image_urls"))


def session_state(events: DataFrame) -> DataFrame:
    """Current sessions from an event log (session_id, owner_id, action, text, ts).

    Actions: create, touch, rename, clear, delete. The first message names an untitled
    session; only the owner can rename or delete; later creates change nothing. A session
    recreated after deletion starts afresh.
    """
    collapsed = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", " "))
    log = events.withColumn("said", collapsed)
    # Deletions by the owner are few; events before the last one no longer matter.
    born = log.where(F.col("action") == "create").groupBy("session_id").agg(F.min_by("owner_id", "ts").alias("owner"))
    ended = (
        log.where(F.col("action") == "delete").join(born, "session_id").where(F.col("owner_id") == F.col("owner"))
        .groupBy("session_id").agg(F.max("ts").alias("ended"))
    )
    live = log.join(born, "session_id").join(ended, "session_id", "left").where(F.col("ended").isNull() | (F.col("ts") > F.col("ended")))
    act = lambda name: F.col("action") == name
    said = F.length("said") > 0
    folded = live.groupBy("session_id").agg(
        F.min(F.when(act("create"), F.struct("ts", "owner_id", F.col("said").alias("title")))).alias("created"),
        F.min(F.when(act("touch") & said, F.struct("ts", "said"))).alias("first_said"),
        F.max(F.when(act("touch") | act("clear"), F.struct("ts", F.when(act("touch"), F.col("said")).otherwise("").alias("said")))).alias("preview"),
        F.max(F.when(act("rename") & said & (F.col("owner_id") == F.col("owner")), F.struct("ts", "said"))).alias("renamed"),
        F.max(F.when(act("touch") | act("clear"), F.col("ts"))).alias("used"),
    ).where(F.col("created").isNotNull())
    default = F.lit(DEFAULT_SESSION_TITLE)
    first = F.col("first_said.said")
    auto = F.when(F.length(first) <= TITLE_CHARS, first).otherwise(F.concat(F.substring(first, 1, TITLE_CHARS), F.lit("…")))
    given = F.nullif(F.col("created.title"), F.lit(""))
    title = F.coalesce(F.col("renamed.said"), F.nullif(given, default), auto, default)
    return folded.select(
        "session_id",
        F.col("created.owner_id").alias("owner_id"),
        title.alias("title"),
        F.col("created.ts").alias("created_at"),
        F.greatest(F.col("created.ts"), F.col("used"), F.col("renamed.ts")).alias("updated_at"),
        F.coalesce(F.col("preview.said"), F.lit("")).alias("last_message"),
    )
