"""Items and their comments, kept from one sync to the next: as a stream with keyed state, and batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import staged

#: What a pull brings: an item (kind card or pr) or a comment on a number (kind comment or review). id is a comment's.
RECORD = "repo string, number long, kind string, id long, updated string, author string, title string, body string, state string, file string"
_COMMENT = "id long, date string, author string, body string, file string"
#: An item as it stands, with all comments it has, by date and id.
ITEM = f"repo string, kind string, number long, updated string, author string, title string, body string, state string, comments array<struct<{', '.join(c.replace(' ', ':') for c in _COMMENT.split(', '))}>>"
_FIELDS = ["updated", "author", "title", "body", "state"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Items(StatefulProcessor):
    """State of one number of a repository: its card and its pull request, and each comment by itself, so that a new
    comment writes one entry, however many there are.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "kind string", ", ".join(f"{c} string" for c in _FIELDS))
        self.comments = handle.getMapState("comments", "kind string, id long", "date string, author string, body string, file string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        clean = lambda x: None if pd.isna(x) else x
        changed = set()
        for r in new[new["kind"].isin(["card", "pr"])].sort_values("updated", na_position="first").itertuples():
            had = self.items.getValue((r.kind,)) if self.items.containsKey((r.kind,)) else None
            value = tuple(clean(getattr(r, c)) for c in _FIELDS)
            if had is None or had[0] != value[0]:
                changed.add(r.kind)
            self.items.updateValue((r.kind,), value)
        for r in new[new["kind"].isin(["comment", "review"]) & new["id"].notna()].sort_values(["updated", "body"], na_position="first").itertuples():
            kind = "pr" if r.kind == "review" or not self.items.containsKey(("card",)) else "card"
            at = (kind, int(r.id))
            if not self.items.containsKey((kind,)) or self.comments.containsKey(at):
                continue
            self.comments.updateValue(at, tuple(map(clean, (r.updated, r.author, r.body, r.file if r.kind == "review" else None))))
            changed.add(kind)
        out = []
        for kind in sorted(changed):
            said = sorted(((v[0] or "", k[1], v) for k, v in self.comments.iterator() if k[0] == kind), key=lambda x: x[:2])
            listed = [{"id": i, "date": v[0], "author": v[1], "body": v[2], "file": v[3]} for _, i, v in said]
            out.append((key[0], kind, key[1], *self.items.getValue((kind,)), listed))
        yield pd.DataFrame(out, columns=["repo", "kind", "number", *_FIELDS, "comments"])

    def close(self) -> None:
        pass


def synced_stream(pulls: DataFrame) -> DataFrame:
    """Items (``ITEM``) that a micro-batch changed, from a stream of ``RECORD`` rows; the last row of an item is how it stands.

    An item that comes again replaces its fields and keeps its comments. A comment goes to the card of its number, if
    there is one, else to the pull request; a review always to the pull request. One whose id the item has is passed over, so
    syncs may read an overlap twice; one on a number without an item is dropped, as is one without an id. An item is changed if it is
    new, its time differs, or it has a new comment. Within a batch items go before comments, both by time.

    State is kept in RocksDB under the checkpoint; the session's state store has to be ``ROCKS``.
    """
    return pulls.groupBy("repo", "number").transformWithStateInPandas(_Items(), ITEM, "Update", "None")


def synced(state: DataFrame, pulls: DataFrame) -> DataFrame:
    """The same for one pull as a batch: all items of ``state`` (``ITEM``) and ``pulls`` (``RECORD``), with ``changed``.

    Comments meet items by joins and are put together once at the end; a comment's key has its id, so a number that
    everyone comments on spreads over tasks until then.
    """
    key = ["repo", "kind", "number"]
    pulls = staged(pulls)
    fresh = pulls.where("kind IN ('card', 'pr')").groupBy(*key).agg(F.max_by(F.struct(*_FIELDS), F.coalesce("updated", F.lit(""))).alias("new"))
    old = state.select(*key, F.struct(*_FIELDS).alias("old"))
    same = lambda a, b: a["repo"].eqNullSafe(b["repo"]) & (a["kind"] == b["kind"]) & a["number"].eqNullSafe(b["number"])
    items = fresh.join(old, same(fresh, old), "full")
    take = lambda c: F.coalesce(fresh[c], old[c]).alias(c)
    items = staged(items.select(*map(take, key), F.coalesce("new", "old").alias("item"), (F.col("new").isNotNull() & (F.col("old").isNull() | ~F.col("old.updated").eqNullSafe(F.col("new.updated")))).alias("touched")))
    cards = items.where("kind = 'card'").select(F.col("repo").alias("_r"), F.col("number").alias("_n"))
    said = pulls.where("kind IN ('comment', 'review') AND id IS NOT NULL")
    said = said.join(cards.withColumn("_card", F.lit(True)), said["repo"].eqNullSafe(F.col("_r")) & said["number"].eqNullSafe(F.col("_n")), "left")
    kind = F.when((F.col("kind") == "review") | F.col("_card").isNull(), "pr").otherwise("card")
    one = F.struct(F.coalesce("updated", F.lit("")).alias("o1"), F.coalesce("body", F.lit("")).alias("o2"), F.col("updated").alias("date"), "author", "body", F.when(F.col("kind") == "review", F.col("file")).alias("file"))
    said = said.select("repo", kind.alias("kind"), "number", "id", one.alias("c")).groupBy(*key, "id").agg(F.min("c").alias("c"))
    has = state.select(*key, F.explode("comments").alias("c")).select(*key, F.col("c.id").alias("id"), F.struct("c.date", "c.author", "c.body", "c.file").alias("c"), F.lit(False).alias("fresh"))
    said = said.select(*key, "id", F.struct("c.date", "c.author", "c.body", "c.file").alias("c"), F.lit(True).alias("fresh"))
    every = has.unionByName(said).groupBy(*key, "id").agg(F.min_by("c", "fresh").alias("c"), F.min("fresh").alias("fresh"))
    entry = F.struct(F.coalesce("c.date", F.lit("")).alias("_d"), "id", "c.date", "c.author", "c.body", "c.file")
    talk = every.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("talk"), F.max("fresh").alias("more"))
    rows = items.join(talk, same(items, talk), "left").drop(*(talk[c] for c in key))
    listed = F.transform(F.coalesce("talk", F.array()), lambda x: F.struct(*(x[c].alias(c) for c in ("id", "date", "author", "body", "file"))))
    return rows.select(*key, "item.*", listed.alias("comments"), (F.col("touched") | F.coalesce("more", F.lit(False))).alias("changed"))
