"""Annotation sets as tables: add, remove, update, list, group, and the replay of their history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Appends; ids are not made unique."""
    return rows.unionByName(new, allowMissingColumns=True)


def anchored(new: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """new annotations (*by, id, type, y, item_index, rects) as they are added: notes without an anchor get the item that is nearest in height, and highlights with one lose their rectangles, which follow from it."""
    from folioscan.operators import geometry

    loose = new.where("type = 'note' AND item_index IS NULL").select(*by, F.col("id").alias("point_id"), "y")
    near = geometry.nearest(items, loose, by).select(*by, F.col("point_id").alias("id"), F.col("item_index").alias("_near"))
    found = new.join(near, [*by, "id"], "left").withColumn("item_index", F.coalesce("item_index", "_near")).drop("_near")
    return found.withColumn("rects", F.when(~((F.col("type") == "highlight") & F.col("item_index").isNotNull()), F.col("rects")))


def _first(rows: DataFrame, ids: DataFrame, order: str) -> DataFrame:
    """Of the rows of each of the ids the place of the first."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(order).alias(order))


def remove(rows: DataFrame, ids: DataFrame, order: str = "seq") -> DataFrame:
    """rows without the first row of each of the ids; ids need not be unique. Rows without the column of their order are one to an id."""
    if order not in rows.columns:
        return rows.join(ids.select("id").distinct(), "id", "left_anti")
    return rows.join(_first(rows, ids, order), ["id", order], "left_anti")


def update(rows: DataFrame, changed: DataFrame, order: str = "seq") -> DataFrame:
    """rows with the first row of each changed id replaced, in its place; changes to ids that aren't there are dropped."""
    if order not in rows.columns:
        return remove(rows, changed).unionByName(changed.join(rows.select("id").distinct(), "id", "left_semi"))
    first = _first(rows, changed, order)
    placed = changed.drop(order).join(first, "id").select(rows.columns)
    return rows.join(first, ["id", order], "left_anti").unionByName(placed)


def titled(rows: DataFrame) -> DataFrame:
    """rows with `title`: the trimmed text, or the type's default, and `preview`, a note's first 50 characters."""
    text = F.trim(F.coalesce("text", F.lit("")))
    named = F.when(text != "", text)
    title = F.when(F.col("type") == "note", F.coalesce(named, F.lit("Empty note"))).when(F.col("type") == "highlight", F.coalesce(named, F.lit("Highlight"))).otherwise("Drawing")
    preview = F.when(F.length("text") > 50, F.concat(F.substring("text", 1, 50), F.lit("..."))).otherwise(F.col("text"))
    return rows.withColumns({"title": title, "preview": F.when(F.col("type") == "note", preview)})


def listed(rows: DataFrame) -> DataFrame:
    """rows with `place` in the order of page and type, and of `seq` among equals, page by page."""
    from pyspark.sql import Window

    before = rows.groupBy("page_index").agg(F.count("*").alias("_n"))
    base = before.select(F.col("page_index"), F.coalesce(F.sum("_n").over(Window.orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = rows.withColumn("_k", F.row_number().over(Window.partitionBy("page_index").orderBy("type", "seq")))
    return own.join(base, "page_index").withColumn("place", F.col("_base") + F.col("_k")).drop("_base", "_k")


def by_page(rows: DataFrame) -> DataFrame:
    """page_index, n, n_notes, has_notes, first and last id (by seq)."""
    note = F.col("type") == "note"
    return rows.groupBy("page_index").agg(
        F.count("*").alias("n"), F.count_if(note).alias("n_notes"), F.bool_or(note).alias("has_notes"), F.min_by("id", "seq").alias("first_id"), F.max_by("id", "seq").alias("last_id")
    )


def replay(log: DataFrame) -> DataFrame:
    """The live annotations after a log (id, seq, action, state): add makes an absent one, update changes a present one, remove takes it away.

    All in aggregates by id, combined before the shuffle: the last remove, the first add after it, the last update after that.
    """
    gone = log.where("action = 'remove'").groupBy("id").agg(F.max("seq").alias("_gone"))
    later = log.where("action <> 'remove'").join(gone, "id", "left").where("_gone IS NULL OR seq > _gone")
    born = later.where("action = 'add'").groupBy("id").agg(F.min(F.struct("seq", "state")).alias("_born"))
    changed = later.where("action = 'update'").join(born, "id").where("seq > _born.seq").groupBy("id").agg(F.max(F.struct("seq", "state")).alias("_last"), F.count("*").alias("n_updates"))
    return born.join(changed, "id", "left").select(
        "id", F.col("_born.seq").alias("born_seq"), F.coalesce("_last.seq", "_born.seq").alias("seq"), F.coalesce("_last.state", "_born.state").alias("state"), F.coalesce("n_updates", F.lit(0)).alias("n_updates")
    )


def replace_page(rows: DataFrame, page: int, new: DataFrame) -> DataFrame:
    """rows with those of one page replaced by the rows of new that are on it."""
    return rows.where(F.col("page_index") != page).unionByName(new.where(F.col("page_index") == page))


def page_lists(rows: DataFrame) -> DataFrame:
    """page_index and the ids on it in the order of seq."""
    return rows.groupBy("page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("ids"))


def preview(rows: DataFrame) -> DataFrame:
    """id and the list's label: the type, and a note's first 50 characters or a drawing's number of points (n_points)."""
    text = F.coalesce("text", F.lit(""))
    note = F.when(text == "", "(Empty note)").when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
    label = F.when(F.col("type") == "note", note).when(F.col("type") == "drawing", F.concat(F.col("n_points").cast("string"), F.lit(" points"))).otherwise(F.trim(text))
    return rows.select("id", F.initcap("type").alias("kind"), label.alias("label"))


def new_notes(places: DataFrame, color: str) -> DataFrame:
    """Notes at places (page_index, x, y, text, created_at), with ids from what they are made of: the same on a rerun."""
    key = F.sha2(F.concat_ws("|", "page_index", "x", "y", F.coalesce("text", F.lit("")), F.unix_millis("created_at")), 256)
    made = F.concat(F.lit("ann_"), F.unix_millis("created_at").cast("string"), F.lit("_"), F.substring(key, 1, 9))
    return places.select(made.alias("id"), F.lit("note").alias("type"), F.lit(color).alias("color"), "page_index", "x", "y", F.coalesce("text", F.lit("")).alias("text"), "created_at")


# The colours and widths to choose from.
CATALOG = {
    "drawing": {"Red": "#E91E63", "Blue": "#2196F3", "Green": "#4CAF50", "Black": "#333333", "Orange": "#FF5722"},
    "highlight": {"Yellow": "#FFEB3B", "Green": "#4CAF50", "Blue": "#2196F3", "Pink": "#E91E63", "Orange": "#FF5722"},
    "note": {"Yellow": "#FFEB3B", "Green": "#4CAF50", "Blue": "#2196F3", "Pink": "#E91E63", "Orange": "#FF5722"},
    "width": {"Thin": "1", "Normal": "2", "Thick": "4", "Extra Thick": "6"},
}


def with_catalog_color(rows: DataFrame) -> DataFrame:
    """rows (type, color_name) with `color`, that name's value for the type."""
    values = F.create_map(*[F.lit(x) for kind, own in CATALOG.items() for name, value in own.items() for x in (f"{kind}/{name}", value)])
    return rows.withColumn("color", values[F.concat_ws("/", "type", "color_name")])


def history_entries(log: DataFrame) -> DataFrame:
    """id, seq, before and after of each change of a log (id, seq, action, state) that takes effect: an addition has no before, a removal no after.

    As in `replay`, an id that is there is not added again, and one that isn't there is neither changed nor removed. Between
    two removals of an id the first addition counts, and what comes after it.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("id").orderBy("seq")
    life = F.coalesce(F.sum((F.col("action") == "remove").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lives = log.withColumn("_life", life)
    born = F.min(F.when(F.col("action") == "add", F.col("seq"))).over(Window.partitionBy("id", "_life"))
    real = lives.withColumn("_born", born).where("(action = 'add' AND seq = _born) OR (action <> 'add' AND seq > _born)")
    was = F.lag("state").over(Window.partitionBy("id", "_life").orderBy("seq"))
    return real.select("id", "seq", F.when(F.col("action") != "add", was).alias("before"), F.when(F.col("action") != "remove", F.col("state")).alias("after"))


class _Document:
    """A document's annotations in order, and its two stacks of changes (action, id, before, after)."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.done: list[tuple] = []
        self.back: list[tuple] = []

    def at(self, id_: object) -> int:
        return next((k for k, row in enumerate(self.rows) if row[0] == id_), -1)

    def apply(self, action: str, id_: object, state: object) -> tuple | None:
        """The change, if it took effect: additions go to the end, the others take the first of the id."""
        k = self.at(id_)
        if action == "add":
            self.rows.append([id_, state])
            return action, id_, None, state
        if k < 0:
            return None
        before = self.rows[k][1]
        if action == "remove":
            del self.rows[k]
            return action, id_, before, None
        self.rows[k][1] = state
        return action, id_, before, state

    def step(self, action: str, id_: object, state: object) -> None:
        if action == "undo" and self.done:
            what, own, before, _ = change = self.done.pop()
            self.apply({"add": "remove", "remove": "add"}.get(what, what), own, before)
            self.back.append(change)
        elif action == "redo" and self.back:
            what, own, _, after = change = self.back.pop()
            self.apply(what, own, after)
            self.done.append(change)
        elif action not in ("undo", "redo") and (change := self.apply(action, id_, state)):
            self.done.append(change)
            self.back = []


def restored(log: DataFrame) -> DataFrame:
    """doc, place, id, state of the annotations that are there after a log (doc, seq, action, id, state) of additions, updates, removals, undos and redos.

    An undone removal comes back at the end, and an undone update with the state it had. The log is dealt out by document and
    sorted; a task goes through it holding one document.
    """
    names = ["doc", "place", "id", "state"]
    types = {f.name: f.dataType.simpleString() for f in log.schema}

    def fold(batches):
        import pyarrow as pa

        own, held, kinds = None, _Document(), None
        for batch in batches:
            kinds = kinds or [batch.schema.field("doc").type, pa.int64(), batch.schema.field("id").type, batch.schema.field("state").type]
            out: list[tuple] = []
            for doc, action, id_, state in zip(*(batch.column(c).to_pylist() for c in ("doc", "action", "id", "state")), strict=True):
                if doc != own:
                    out += [(own, k, *row) for k, row in enumerate(held.rows, 1)]
                    own, held = doc, _Document()
                held.step(action, id_, state)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=names)
        if held.rows:
            rows = [(own, k, *row) for k, row in enumerate(held.rows, 1)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ordered = log.repartition("doc").sortWithinPartitions("doc", "seq").select("doc", "action", "id", "state")
    return ordered.mapInArrow(fold, f"doc {types['doc']}, place long, id {types['id']}, state {types['state']}")


def undone(log: DataFrame) -> DataFrame:
    """doc, place and change of the changes in force after a log (doc, seq, action, change) of changes, undos and redos, in the order of seq.

    A change clears what may be redone. The log is dealt out by document and sorted; a task goes through it holding the
    two stacks of one document.
    """
    names = ["doc", "place", "change"]

    def fold(batches):
        import pyarrow as pa

        own, done, back = None, [], []
        rows: list[list] = [[], [], []]

        def close() -> None:
            rows[0].extend([own] * len(done))
            rows[1].extend(range(1, len(done) + 1))
            rows[2].extend(done)

        for batch in batches:
            for doc, action, change in zip(*(batch.column(c).to_pylist() for c in ("doc", "action", "change")), strict=True):
                if doc != own:
                    close()
                    own, done, back = doc, [], []
                if action == "undo":
                    if done:
                        back.append(done.pop())
                elif action == "redo":
                    if back:
                        done.append(back.pop())
                else:
                    done.append(change)
                    back = []
            yield pa.record_batch([pa.array(x, pa.int64()) for x in rows], names=names)
            rows = [[], [], []]
        close()
        yield pa.record_batch([pa.array(x, pa.int64()) for x in rows], names=names)

    ordered = log.repartition("doc").sortWithinPartitions("doc", "seq").select("doc", "action", "change")
    return ordered.mapInArrow(fold, "doc long, place long, change long")


def latest_epoch(results: DataFrame, by: list[str]) -> DataFrame:
    """Of results (*by, epoch, ...) those of the latest epoch; late ones of earlier epochs go."""
    last = results.groupBy(*by).agg(F.max("epoch").alias("epoch"))
    return results.join(last, [*by, "epoch"], "left_semi")


def changed_renders(requests: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of requests (*by, render_key, ...) in their order those whose key differs from the one before."""
    from pyspark.sql import Window

    was = F.lag("render_key").over(Window.partitionBy(*by).orderBy(order))
    return requests.withColumn("_was", was).where(~F.col("_was").eqNullSafe(F.col("render_key"))).drop("_was")
