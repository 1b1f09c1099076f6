"""Tables that change: staged edits with refusals, tokens, notifications, proposals, source entities, queues.

Every operator returns the new rows or the new state of a table; the caller writes it as a new version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import hierarchy

#: Open proposals of one person, and replies of one person in an hour, at most.
MOST_OPEN, MOST_HOURLY = 5, 2
#: A snapshot is made anew after so many new pairs, or an hour.
PAIRS, HOUR = 1000, 3600


def refused(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """rows with `refusal`: the message of the first rule that holds, null where none does."""
    out = F.lit(None).cast("string")
    for holds, message in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(message)).otherwise(out)
    return rows.withColumn("refusal", out)


def drop_mentions(mentions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions left, snapshot, edits with status and refusal) after staged drops (edit_id, link_id, entity_id, status).

    An edit whose mention is gone is refused; an applied or undone one is left alone. The snapshot holds what was dropped.
    """
    keys = ["link_id", "entity_id"]
    there = mentions.select(*keys).distinct().withColumn("_there", F.lit(True))
    staged = F.col("status") == "staged"
    judged = refused(edits.join(there, keys, "left"), [(~staged, "not staged"), (F.col("_there").isNull(), "no such mention")])
    judged = judged.withColumn("status", F.when(F.col("refusal").isNull(), "applied").otherwise(F.col("status"))).drop("_there")
    done = judged.where("refusal is null").select(*keys, "edit_id")
    first = done.groupBy(*keys).agg(F.min("edit_id").alias("edit_id"))
    snapshot = mentions.join(first, keys)
    return mentions.join(first.select(*keys), keys, "left_anti"), snapshot, judged


def undo_order(edits: DataFrame) -> DataFrame:
    """(edit_id, refusal) of applied edits (edit_id, touched array): only the last edit of every id it touches may be undone."""
    touched = edits.select("edit_id", F.explode("touched").alias("id"))
    last = touched.groupBy("id").agg(F.max("edit_id").alias("last"))
    later = touched.join(last, "id").groupBy("edit_id").agg(F.max("last").alias("later"))
    return later.select("edit_id", F.when(F.col("later") > F.col("edit_id"), F.concat(F.lit("undo edit "), "later", F.lit(" first"))).alias("refusal"))


def mark_read(notes: DataFrame, recipient: int, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes after, count): the recipient's own unread notes (note_id, recipient, read) among ids (note_id) are read."""
    asked = ids.select("note_id").distinct().withColumn("_asked", F.lit(True))
    rows = notes.join(asked, "note_id", "left").withColumn("_now", (F.col("recipient") == recipient) & ~F.col("read") & F.coalesce("_asked", F.lit(False)))
    return rows.withColumn("read", F.col("read") | F.col("_now")).select(*notes.columns), rows.agg(F.count_if("_now").alias("n"))


def proposal_refusals(proposals: DataFrame, topics: DataFrame) -> DataFrame:
    """proposals (proposal_id, person, topic) with refusal: too many open ones, a topic that is there, one under no topic, one inside the tree."""
    parents = topics.select(hierarchy.parent(F.col("topic")).alias("topic")).where("topic is not null").distinct().withColumn("_inner", F.lit(True))
    known = topics.select("topic").distinct().withColumn("_known", F.lit(True))
    above = topics.select(F.col("topic").alias("_parent")).distinct().union(parents.select("topic")).distinct().withColumn("_under", F.lit(True))
    order = Window.partitionBy("person").orderBy("proposal_id")
    rows = proposals.withColumn("_parent", hierarchy.parent(F.col("topic"))).join(known, "topic", "left").join(parents, "topic", "left").join(above, "_parent", "left")
    rows = rows.withColumn("_open", F.row_number().over(order))
    rules = [(F.col("_open") > MOST_OPEN, "too many open proposals"), (F.col("_inner"), "not a leaf"), (F.col("_known"), "already a topic"), (F.col("_under").isNull(), "no such parent")]
    return refused(rows, rules).select("proposal_id", "person", "topic", "refusal")


@dataclass(frozen=True)
class Proposals:
    """proposals with their new status; topics and labels with what was accepted; decisions (proposal_id, accept, refusal)."""

    proposals: DataFrame
    topics: DataFrame
    labels: DataFrame
    decisions: DataFrame


def decide_proposals(proposals: DataFrame, decisions: DataFrame, topics: DataFrame, examples: DataFrame, labels: DataFrame) -> Proposals:
    """What a batch of decisions (proposal_id, accept, at) makes of proposals (proposal_id, person, topic, name, status).

    An accepted proposal becomes a topic (topic, name, proposed_by) and its examples (proposal_id, link_id, p) become labels (link_id,
    topic, p, labeled_by), but where a label is there already. Refused, with the proposal left as it was: a decision on no open proposal,
    any but the first on one proposal in a batch, and a topic that is there or that an earlier proposal of the batch makes.
    """
    order = Window.partitionBy("proposal_id").orderBy("at", F.desc("accept"))
    rows = decisions.withColumn("_turn", F.row_number().over(order)).join(proposals, "proposal_id", "left")
    rows = rows.join(topics.select("topic").distinct().withColumn("_known", F.lit(True)), "topic", "left")
    asks = F.col("accept") & (F.col("status") == "open") & (F.col("_turn") == 1)
    makers = Window.partitionBy("topic")
    rows = rows.withColumn("_maker", F.min(F.when(asks, F.col("proposal_id"))).over(makers))
    later = F.col("accept") & (F.col("_known") | (F.col("proposal_id") != F.col("_maker")))
    rules = [(F.col("status").isNull() | (F.col("status") != "open"), "no open proposal"), (F.col("_turn") > 1, "decided already"), (later, "already a topic")]
    judged = refused(rows, rules)
    done = judged.where("refusal is null").select("proposal_id", "accept", "topic", "person", "name")
    accepted = done.where("accept")
    status = F.when(F.col("accept"), "accepted").when(~F.col("accept"), "rejected").otherwise(F.col("status"))
    after = proposals.join(done.select("proposal_id", "accept"), "proposal_id", "left").withColumn("status", status).select(*proposals.columns)
    new = accepted.select("topic", F.trim("name").alias("name"), F.col("person").alias("proposed_by"))
    made = examples.join(accepted.select("proposal_id", "topic"), "proposal_id").groupBy("link_id", "topic").agg(F.max("p").alias("p")).withColumn("labeled_by", F.lit("manual"))
    made = made.join(labels.select("link_id", "topic"), ["link_id", "topic"], "left_anti")
    return Proposals(after, new, made, judged.select("proposal_id", "accept", "refusal"))


def decided(queue: DataFrame, allowed: Column) -> DataFrame:
    """Pending rows of a queue, each decided once: `sent` or `refused`; rows decided before stay out."""
    return queue.where("status = 'pending'").withColumn("status", F.when(F.coalesce(allowed, F.lit(False)), "sent").otherwise("refused"))


def token_states(changes: DataFrame, token: str, order: str) -> DataFrame:
    """(token, owner, state) from changes (token, order, owner, action): request, approve, revoke; a revoked token never comes back, only a pending one is approved."""
    known = changes.where(F.col("action").isin("request", "approve", "revoke"))
    first = F.min_by("owner", order).alias("owner")
    requested = F.min(F.when(F.col("action") == "request", F.col(order)))
    approved = F.max(F.when(F.col("action") == "approve", F.col(order)))
    revoked = F.max((F.col("action") == "revoke").cast("int"))
    rows = known.groupBy(token).agg(first, requested.alias("r"), approved.alias("a"), revoked.alias("x"))
    state = F.when(F.col("x") == 1, "revoked").when(F.col("a") > F.col("r"), "active").otherwise("pending")
    return rows.where("r is not null").select(token, "owner", state.alias("state"))


def source_entities(sources: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source_id, entity_id), new entities): find or create by folded name and kind; sources of one name share one.

    sources (source_id, name, kind), entities (entity_id, name, kind). A new entity's id is its first source's, negative.
    """
    found = entities.groupBy(F.lower("name").alias("_key"), "kind").agg(F.min("entity_id").alias("entity_id"))
    rows = sources.withColumn("_key", F.lower("name")).join(found, ["_key", "kind"], "left")
    fresh = rows.where("entity_id is null").groupBy("_key", "kind").agg((-F.min("source_id")).alias("_new"), F.min_by("name", "source_id").alias("name"))
    linked = rows.join(fresh.select("_key", "kind", "_new"), ["_key", "kind"], "left").select("source_id", F.coalesce("entity_id", "_new").alias("entity_id"))
    return linked, fresh.select(F.col("_new").alias("entity_id"), "name", "kind")


def retagged(tags: DataFrame, sources: DataFrame) -> DataFrame:
    """(link_id, source, change): the tags to add and to take off so that tags (link_id, source) become sources (link_id, source)."""
    have, want = tags.select("link_id", "source").distinct(), sources.where("source is not null").select("link_id", "source").distinct()
    both = have.withColumn("_had", F.lit(True)).join(want.withColumn("_has", F.lit(True)), ["link_id", "source"], "full")
    return both.where("_had is null or _has is null").select("link_id", "source", F.when(F.col("_has").isNull(), "remove").otherwise("add").alias("change"))


#: Why an anonymous session may not be merged into an account; the first that holds.
MERGE_REFUSALS = ("sign in before merging", "only an anonymous session can be merged", "that session is already this account")


def merge_plans(pairs: DataFrame) -> DataFrame:
    """pairs (session, session_anonymous, account, account_anonymous) with refusal."""
    rules = (~F.col("account_anonymous").eqNullSafe(F.lit(False)), ~F.col("session_anonymous").eqNullSafe(F.lit(True)), F.col("session") == F.col("account"))
    return refused(pairs, list(zip(rules, MERGE_REFUSALS)))


def changes_of(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change) between two versions of a table: insert, update, delete; rows alike in every column are no change."""
    values = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    both = a.join(b, list(keys), "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    return both.select(*keys, change.alias("change"))


def generation(changes: Column, carried: Sequence[str], gen: Column) -> Column:
    """The generation after changes (an array of kinds): one more where a kind is no log entry."""
    return gen + F.exists(changes, lambda c: ~c.isin(*carried)).cast("int")


def must_rebuild(moved: Column, added: Column, age_seconds: Column, new_pairs: Column) -> Column:
    """Whether a snapshot is made anew: its generation moved, or there is something new and it is old or much is new."""
    return moved | (added & ((age_seconds >= HOUR) | (new_pairs >= PAIRS)))


def published(state: DataFrame, path: str, gen: int, marks: dict[str, int]) -> DataFrame:
    """The one row of a published snapshot in place of the old one."""
    row = [F.lit(path).alias("path"), F.lit(gen).alias("gen"), *[F.lit(v).cast("long").alias(k) for k, v in marks.items()]]
    return state.limit(1).select(*row)


def newest_snapshots(files: DataFrame, keep: int = 3) -> DataFrame:
    """files (name, gen, seq) with `kept`: the newest ones; the others are to be deleted."""
    order = Window.orderBy(F.desc("gen"), F.desc("seq"))
    return files.withColumn("kept", F.row_number().over(order) <= keep)  # a handful of files


def work(queue: DataFrame, done: DataFrame, key: str, newest: str, most: int) -> DataFrame:
    """The newest `most` rows of a queue that are not done yet."""
    return queue.join(done.select(key), key, "left_anti").orderBy(F.desc(newest), F.desc(key)).limit(most)
