"""Schemas that drift between files (problem 3).

1. One Arrow pass over all lines gives each file's schema tree: every path with the JSON types
   seen there. Counts are combined within a batch, then by an aggregation.
2. For paths that end and paths that begin between two consecutive files, a second pass reads
   only those paths and compares their values word by word.
3. Each pair of schema trees is aligned by a tree edit distance: deleting or adding a node
   costs 1, renaming one costs the share of words whose values disagree, keeping one is free.
   The children of two aligned nodes are matched at minimum cost (unordered trees, top down).
   A subtree that ends at one place and begins with the same values at another is a move.
   A move is part of the cost: deleting or adding a node that could be moved costs half the move.
4. The scripts of all later files are compiled into projections, Spark expressions over variants:
   each field of the newest schema is read from where its file has it and gets one type.

Driver and single tasks hold schemas only (paths and types), never records.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.strict_json import json_type, loads_object
from lexloom.tables import broadcast_if_small, materialized

#: What it costs to take a field to another parent, besides the share of words whose values differ.
MOVE = 0.5
#: A path was renamed if more than this share of the words that both files have hold the same values.
SAME = 0.5
CHANGE = "pair int, file_name string, change_kind string, field_path string, new_path string, old_types string, new_types string"


def walk(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """(path, value) of every key of every object; arrays add nothing to a path."""
    if isinstance(value, list):
        for item in value:
            yield from walk(item, path)
    elif isinstance(value, dict):
        for key, item in value.items():
            below = f"{path}.{key}" if path else key
            yield below, item
            yield from walk(item, below)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, ".") > 0, F.regexp_replace(path, r"\.[^.]*$", "")).otherwise(F.lit(""))


def file_order(files: DataFrame) -> DataFrame:
    """(file_name, pair): pair numbers the files from 0 by the date in their names, then by name."""
    names = files.select("file_name").where("file_name is not null").distinct()
    return names.select("file_name", (F.row_number().over(Window.orderBy(F.regexp_extract("file_name", r"(\d{8})", 1), "file_name")) - 1).alias("pair"))


class SchemaTree:
    """The types at each key and list item of all records taken in; a path is spelled out once, not once per value."""

    __slots__ = ("kinds", "below", "items")

    def __init__(self) -> None:
        self.kinds: dict[str, int] = {}
        self.below: dict[str, SchemaTree] = {}
        self.items: SchemaTree | None = None

    def take(self, value: Any) -> None:
        kind = _KINDS.get(type(value)) or _kind(value)
        self.kinds[kind] = self.kinds.get(kind, 0) + 1
        if kind == "object":
            for key, item in value.items():
                tree = self.below.get(key)
                if tree is None:
                    tree = self.below[key] = SchemaTree()
                tree.take(item)
        elif kind == "array" and value:
            if self.items is None:
                self.items = SchemaTree()
            for item in value:
                self.items.take(item)

    def nodes(self, path: str = "") -> Iterator[tuple[str, str, int]]:
        """(node, type, n): lists are marked by [] in a node's path. Whole numbers are told apart."""
        below = [(f"{path}.{key}" if path else key, tree) for key, tree in self.below.items()]
        for node, tree in below + ([(f"{path}[]", self.items)] if self.items else []):
            yield from ((node, kind, n) for kind, n in tree.kinds.items())
            yield from tree.nodes(node)


_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean"}


def _kind(value: Any) -> str:
    return "integer" if isinstance(value, int) and abs(value) < 1 << 63 else json_type(value)


def schema_nodes(files: DataFrame) -> DataFrame:
    """(file_name, node, kind, n): the types at each node of each file's schema, see SchemaTree. Lines that aren't an object don't count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees: dict[str, SchemaTree] = defaultdict(SchemaTree)
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = loads_object(text)
                if record is not None:
                    trees[name].take(record)
            out = [(name, *row) for name, tree in trees.items() for row in tree.nodes()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["file_name", "node", "kind", "n"])

    read = files.select("file_name", "source_json").where("file_name is not null and source_json is not null")
    found = read.mapInArrow(rows, "file_name string, node string, kind string, n long")
    return found.groupBy("file_name", "node", "kind").agg(F.sum("n").alias("n"))


def schema_paths(found: DataFrame) -> DataFrame:
    """(file_name, path, kind, n) of schema_nodes(): the JSON types of the values of each key; lists add nothing to a path."""
    kind = F.when(F.col("kind") == "integer", "number").otherwise(F.col("kind"))
    keys = found.where(~F.col("node").endswith("[]")).select("file_name", F.replace("node", F.lit("[]"), F.lit("")).alias("path"), kind.alias("kind"), "n")
    return keys.groupBy("file_name", "path", "kind").agg(F.sum("n").alias("n"))


def path_sides(paths: DataFrame, order: DataFrame) -> DataFrame:
    """(pair, path, before, after): the sorted types of a path in file ``pair`` and in the next one; null where it is absent."""
    typed = paths.join(broadcast_if_small(order), "file_name").groupBy("pair", "path").agg(F.sort_array(F.collect_set("kind")).alias("types"))
    last = order.agg(F.max("pair")).first()[0]
    sides = typed.select(F.explode(F.array(F.struct("pair", F.lit(0).alias("side")), F.struct((F.col("pair") - 1).alias("pair"), F.lit(1).alias("side")))).alias("x"), "path", "types")
    both = sides.groupBy("x.pair", "path").agg(
        F.max(F.when(F.col("x.side") == 0, F.array_join("types", "|"))).alias("before"), F.max(F.when(F.col("x.side") == 1, F.array_join("types", "|"))).alias("after")
    )
    return both.where((F.col("pair") >= 0) & (F.col("pair") < F.lit(last)))


def value_agreement(files: DataFrame, order: DataFrame, sides: DataFrame, word: str) -> DataFrame:
    """(pair, old, new, agree, shared) for paths that end and paths that begin in the same pair, if under one parent or of one name."""
    ended = sides.where("after is null").select("pair", F.col("path").alias("old"))
    begun = sides.where("before is null").select("pair", F.col("path").alias("new"))
    key = lambda c: F.substring_index(c, ".", -1)
    candidates = ended.join(begun, "pair").where((parent(F.col("old")) == parent(F.col("new"))) | (key(F.col("old")) == key(F.col("new")))).distinct()
    wanted: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    names = {r.pair: r.file_name for r in order.collect()}
    pairs = candidates.collect()  # names of fields, never values
    for r in pairs:
        for file, path, side in ((names[r.pair], r.old, 0), (names[r.pair + 1], r.new, 1)):
            if (r.pair, side) not in wanted[file][path]:
                wanted[file][path].append((r.pair, side))
    wanted = {k: dict(v) for k, v in wanted.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths = wanted.get(name)
                record = loads_object(text) if paths else None
                if record is None or not isinstance(record.get(word), str):
                    continue
                for path, value in walk(record):
                    for pair, side in paths.get(path, ()):
                        digest = hashlib.blake2b(json.dumps(value, sort_keys=True).encode(), digest_size=8).digest()
                        for column, x in zip(out, (pair, side, path, record[word], int.from_bytes(digest, "big", signed=True)), strict=True):
                            column.append(x)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["pair", "side", "path", "word", "h"])

    spark = files.sparkSession
    known = spark.createDataFrame([(r.pair, r.old, r.new) for r in pairs], "pair int, old string, new string")
    if not pairs:
        return known.select("*", F.lit(0).cast("long").alias("agree"), F.lit(0).cast("long").alias("shared"))
    named = files.select("file_name", "source_json").where(F.col("file_name").isin(list(wanted)) & F.col("source_json").isNotNull())
    each = named.mapInArrow(rows, "pair int, side int, path string, word string, h long").distinct()
    # The set of a word's values, as a sum of their hashes: a word that many records share is spread over its values first.
    sets = each.groupBy("pair", "side", "path", "word").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("set"))
    old = sets.where("side = 0").select("pair", F.col("path").alias("old"), "word", F.col("set").alias("a"))
    new = sets.where("side = 1").select("pair", F.col("path").alias("new"), "word", F.col("set").alias("b"))
    known = broadcast_if_small(known)
    met = old.join(known, ["pair", "old"]).join(new, ["pair", "new", "word"])
    return met.groupBy("pair", "old", "new").agg(F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count(F.lit(1)).alias("shared"))


def _assignment(cost: list[list[float]]) -> list[int]:
    """Minimum-cost perfect matching of a square matrix; the column of each row."""
    n = len(cost)
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        way, least, done, j0 = [0] * (n + 1), [inf] * (n + 1), [False] * (n + 1), 0
        match[0] = i
        while match[j0]:
            done[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, n + 1):
                if not done[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


class TreeDiff:
    """The cheapest script between two schema trees, given how well ended and begun paths agree in their values."""

    def __init__(self, before: set[str], after: set[str], disagree: dict[tuple[str, str], float]) -> None:
        self.trees = [self._children(before), self._children(after)]
        self.sizes = [self._sizes(t) for t in self.trees]
        self.disagree = disagree
        # Half of what moving a node instead of deleting or adding it saves, at best.
        self.saved: list[dict[str, float]] = [{}, {}]
        for (p, q), off in disagree.items():
            if self.movable(p, q):
                for side, x in enumerate((p, q)):
                    self.saved[side][x] = max(self.saved[side].get(x, 0.0), (2 - MOVE - off) / 2)

    def movable(self, p: str, q: str) -> bool:
        (above, _, key), (above2, _, key2) = p.rpartition("."), q.rpartition(".")
        return key == key2 and above != above2 and self.disagree.get((p, q), 2.0) < SAME

    def moves(self, lost: list[str], gained: list[str]) -> dict[str, str]:
        """The cheapest matching of deleted and added nodes that are moves."""
        lost, gained = [p for p in lost if p in self.saved[0]], [q for q in gained if q in self.saved[1]]
        size = max(len(lost), len(gained))
        worth = lambda i, j: i < len(lost) and j < len(gained) and self.movable(lost[i], gained[j])
        cost = [[MOVE + self.disagree[lost[i], gained[j]] if worth(i, j) else 2.0 for j in range(size)] for i in range(size)]
        return {lost[i]: gained[j] for i, j in enumerate(_assignment(cost)) if worth(i, j)} if size else {}

    @staticmethod
    def _children(paths: set[str]) -> dict[str, list[str]]:
        tree: dict[str, list[str]] = defaultdict(list)
        for path in sorted(paths):
            tree[path.rpartition(".")[0]].append(path)
        return dict(tree)

    @staticmethod
    def _sizes(tree: dict[str, list[str]]) -> dict[str, int]:
        sizes: dict[str, int] = {}
        for path in sorted((p for c in tree.values() for p in c), key=lambda p: -p.count(".")):
            sizes[path] = 1 + sum(sizes[c] for c in tree.get(path, ()))
        return sizes

    def align(self, old: str = "", new: str = "") -> tuple[float, list[tuple[str, str | None, str | None]]]:
        """(cost, script) below two aligned nodes; script: (kind, old path, new path)."""
        a, b = list(self.trees[0].get(old, ())), list(self.trees[1].get(new, ()))
        key = lambda p: p.rpartition(".")[2]
        kept = {key(p) for p in a} & {key(p) for p in b}
        total, script = 0.0, []
        for p in [p for p in a if key(p) in kept]:
            cost, below = self.align(p, f"{new}.{key(p)}" if new else key(p))
            total, script = total + cost, script + below
        a, b = [p for p in a if key(p) not in kept], [p for p in b if key(p) not in kept]
        size = len(a) + len(b)
        # Rows: old children, then room for additions; columns: new children, then room for deletions.
        cost = [[0.0] * size for _ in range(size)]
        done: dict[tuple[int, int], tuple[float, list]] = {}
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                off = self.disagree.get((p, q), 2.0)
                if off < SAME:
                    done[i, j] = self.align(p, q)
                    cost[i][j] = off + done[i, j][0]
                else:
                    cost[i][j] = 1e6
            for j in range(len(b), size):
                cost[i][j] = self.sizes[0][p] - self.saved[0].get(p, 0.0)
        for i in range(len(a), size):
            for j, q in enumerate(b):
                cost[i][j] = self.sizes[1][q] - self.saved[1].get(q, 0.0)
        for i, j in enumerate(_assignment(cost)):
            total += cost[i][j]
            if i < len(a) and j < len(b):
                script.append(("renamed", a[i], b[j]))
                script += done[i, j][1]
            elif i < len(a):
                script += [("removed", p, None) for p in self._below(0, a[i])]
            elif j < len(b):
                script += [("added", None, q) for q in self._below(1, b[j])]
        return total, script

    def _below(self, side: int, path: str) -> list[str]:
        return [path, *(x for c in self.trees[side].get(path, ()) for x in self._below(side, c))]


def edit_scripts(sides: DataFrame, agreement: DataFrame, order: DataFrame) -> DataFrame:
    """The edit script of each pair of consecutive files; file_name is the later file.

    change_kind: added, removed, renamed, moved, retyped, or carried for a field that follows
    its renamed parent. One task holds the schemas of one pair.
    """
    evidence = agreement.where("shared > 0").select("pair", F.col("old").alias("path"), F.col("new").alias("other"), (1 - F.try_divide("agree", "shared")).alias("off"))
    nodes = sides.select("pair", "path", "before", "after", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("off"))
    rows = nodes.unionByName(evidence, allowMissingColumns=True)

    def script(pdf: pd.DataFrame) -> pd.DataFrame:
        pair, known = int(pdf["pair"].iloc[0]), pdf[pdf["other"].isna()]
        before = {r.path: r.before for r in known.itertuples() if isinstance(r.before, str)}
        after = {r.path: r.after for r in known.itertuples() if isinstance(r.after, str)}
        disagree = {(r.path, r.other): r.off for r in pdf[pdf["other"].notna()].itertuples()}
        diff = TreeDiff(set(before), set(after), disagree)
        found = diff.align()[1]
        out: list[tuple] = []
        renames = {old: new for kind, old, new in found if kind == "renamed"}
        lost, gained = [o for k, o, _ in found if k == "removed"], [n for k, _, n in found if k == "added"]
        moves = diff.moves(lost, gained)
        for old, new in renames.items():
            out.append(("renamed", old, new))
            out += [("carried", p, new + p[len(old) :]) for p in before if p.startswith(old + ".") and new + p[len(old) :] in after]
        out += [("moved", old, new) for old, new in moves.items()]
        out += [("removed", p, "") for p in lost if p not in moves]
        out += [("added", p, "") for p in gained if p not in moves.values()]
        out += [("retyped", p, "") for p in before if p in after and before[p] != after[p]]
        frame = pd.DataFrame(out, columns=["change_kind", "field_path", "new_path"])
        frame.insert(0, "pair", pair)
        frame["old_types"] = [before.get(r.field_path, "") for r in frame.itertuples()]
        frame["new_types"] = [after.get(r.new_path or r.field_path, "") for r in frame.itertuples()]
        return frame[["pair", "change_kind", "field_path", "new_path", "old_types", "new_types"]].astype(object)

    made = rows.groupBy("pair").applyInPandas(script, "pair int, change_kind string, field_path string, new_path string, old_types string, new_types string")
    later = order.select((F.col("pair") - 1).alias("pair"), "file_name")
    return made.join(broadcast_if_small(later), "pair").select(*[c.split()[0] for c in CHANGE.split(", ")])


def drift(files: DataFrame, word: str = "word", found: DataFrame | None = None) -> DataFrame:
    """The report of all changes between consecutive files (see edit_scripts).

    files: file_name, source_json. found: schema_nodes(files), if it is at hand. Null and malformed lines and values that aren't objects
    don't count; repeated lines change nothing; a file without any object has an empty schema.
    Fewer than two files give no rows.
    """
    order = file_order(files).transform(materialized)
    sides = materialized(path_sides(schema_paths(schema_nodes(files) if found is None else found), order))
    return edit_scripts(sides, value_agreement(files, order, sides, word), order)


def changes(report: DataFrame) -> DataFrame:
    """(file_name, field_path, change_kind, new_path) with fields of a renamed or moved parent as ended and begun ones."""
    plain = report.where(F.col("change_kind").isin("added", "removed", "renamed", "retyped"))
    split = report.where(F.col("change_kind").isin("carried", "moved"))
    both = split.select(
        "file_name", F.explode(F.array(F.struct(F.col("field_path").alias("p"), F.lit("removed").alias("k")), F.struct(F.col("new_path").alias("p"), F.lit("added").alias("k")))).alias("x")
    ).select("file_name", F.col("x.p").alias("field_path"), F.col("x.k").alias("change_kind"), F.lit("").alias("new_path"))
    return plain.select("file_name", "field_path", "change_kind", "new_path").unionByName(both).distinct()


class Projection:
    """Where each field of the newest schema stands in each file, and its one type. Holds schemas only.

    A field that the newest file doesn't have keeps the name and types of the last file that has it.
    """

    def __init__(self, report: DataFrame, order: DataFrame, found: DataFrame) -> None:
        self.files = [r.file_name for r in sorted(order.collect(), key=lambda r: r.pair)]
        steps = [(r.pair, r.field_path, r.new_path) for r in report.where(F.col("change_kind").isin("renamed", "moved", "carried")).collect()]
        kinds: dict[str, dict[str, dict[str, int]]] = {f: {} for f in self.files}
        for r in found.collect():  # paths and types, never values
            kinds[r.file_name].setdefault(r.node, {})[r.kind] = r.n
        self.kinds = kinds
        #: Newest path of each path of each file: the renames and moves of all later files, one after the other.
        self.names: dict[str, dict[str, str]] = {}
        following: dict[str, str] = {}
        for pair in range(len(self.files) - 1, -1, -1):
            here = {old: new for p, old, new in steps if p == pair}
            following = {old: new for old, new in following.items() if old not in here} | {old: following.get(new, new) for old, new in here.items()}
            self.names[self.files[pair]] = dict(following)
        #: Source node of each newest path by file, and the file whose types hold.
        self.source: dict[str, dict[str, str]] = defaultdict(dict)
        self.holder: dict[str, str] = {}
        for f in self.files:
            for node in sorted(kinds[f]):
                if not node.endswith("[]"):
                    path = node.replace("[]", "")
                    new = self.names[f].get(path, path)
                    # One path may stand at several nodes (in and outside of a list): the first that every later one extends.
                    if new not in self.source or f not in self.source[new]:
                        self.source[new][f] = node
                        self.holder[new] = f
        self.children: dict[str, list[str]] = defaultdict(list)
        for path in sorted(self.source):
            at = path
            while at:  # a moved field may have a parent that no file holds
                above = at.rpartition(".")[0]
                if at in self.children[above]:
                    break
                self.children[above].append(at)
                at = above

    def types(self, path: str, items: str = "") -> set[str]:
        f = self.holder.get(path)
        return {"object"} if f is None else set(self.kinds[f].get(self.source[path][f] + items, {})) - {"null"}

    @staticmethod
    def one(types: set[str]) -> str:
        """The one type of a field: a list if there are lists (others become its items), text if nothing else holds all."""
        if "array" in types:
            return "array"
        if types == {"object"}:
            return "object"
        if types and types <= {"integer", "number"}:
            return "number" if "number" in types else "integer"
        return "boolean" if types == {"boolean"} else "string"

    @staticmethod
    def _get(variant: Column, keys: list[str], kind: str) -> Column:
        """The value below ``keys``; keys that a variant path can't spell are looked up in a map."""
        path = "$"
        for i, key in enumerate(keys):
            if set(key) & set("'?\\[]\""):
                held = F.try_variant_get(variant, path, "map<string, variant>")
                return Projection._get(F.try_element_at(held, F.lit(key)), keys[i + 1 :], kind)
            path += f"['{key}']"
        return F.try_variant_get(variant, path, kind)

    def _at(self, variant: Column, base: dict[str, str], path: str, kind: str) -> Column:
        """The value of ``path`` under the nodes ``base`` that ``variant`` stands for in each file."""
        by_place: dict[str, list[str]] = defaultdict(list)
        for f, node in self.source.get(path, {}).items():
            above = base.get(f)
            if above is not None and (not above or node.startswith(above + ".")) and "[]" not in (rest := node[len(above) :].lstrip(".")):
                by_place[rest].append(f)
        got = [(fs, self._get(variant, rest.split("."), kind)) for rest, fs in sorted(by_place.items())]
        if not got:
            return F.lit(None).cast(kind)
        out = got[-1][1] if len(got) == 1 and set(got[0][0]) == set(self.files) else F.lit(None).cast(kind)
        for fs, value in got:
            out = F.when(F.col("file_name").isin(fs), value).otherwise(out)
        return out

    def value(self, variant: Column, base: dict[str, str], path: str) -> Column:
        kind = self.one(self.types(path))
        if kind == "object":
            if not self.children.get(path):
                return self._at(variant, base, path, "string")
            made = self.struct(variant, base, path)
            moved = [self.value(variant, base, c) for c in self.children[path] if any(self.source.get(path, {}).get(f) is None or not n.startswith(self.source[path][f] + ".") for f, n in self.source.get(c, {}).items())]
            there = self._at(variant, base, path, "variant").isNotNull()
            for c in moved:
                there = there | c.isNotNull()
            return F.when(there, made)
        if kind == "array":
            whole = self._at(variant, base, path, "variant")
            listed = F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.when(whole.isNotNull() & ~F.is_variant_null(whole), F.array(whole)))
            return F.transform(listed, lambda x: self._item(x, path, "[]"))
        plain = self._at(variant, base, path, {"number": "double", "integer": "bigint"}.get(kind, kind))
        if kind == "string" and any("array" in self.kinds[f].get(node, {}) for f, node in self.source.get(path, {}).items()):
            return F.coalesce(F.array_join(self._at(variant, base, path, "array<string>"), "、"), plain)
        return plain

    def _item(self, item: Column, path: str, marks: str) -> Column:
        kind = self.one(self.types(path, marks))
        if kind == "array":
            listed = F.coalesce(F.try_variant_get(item, "$", "array<variant>"), F.array(item))
            return F.transform(listed, lambda x: self._item(x, path, marks + "[]"))
        if kind == "object" and self.children.get(path):
            base = {f: node + marks for f, node in self.source[path].items()}
            return F.when(~F.is_variant_null(item), self.struct(item, base, path))
        return F.try_variant_get(item, "$", {"number": "double", "integer": "bigint", "object": "string"}.get(kind, kind))

    def struct(self, variant: Column, base: dict[str, str], path: str) -> Column:
        return F.struct(*[c for _, c in self.columns(variant, base, path)])

    def columns(self, variant: Column, base: dict[str, str], path: str, taken: set[str] = frozenset()) -> list[tuple[str, Column]]:
        """(newest path, column) of the fields below ``path``; a name that another one has but for case gets a number."""
        out, used = [], set(taken)
        for child in self.children[path]:
            name, n = child.rpartition(".")[2], 1
            while (unique := name if n == 1 else f"{name}_{n}").casefold() in used:
                n += 1
            used.add(unique.casefold())
            out.append((child, self.value(variant, base, child).alias(unique)))
        return out


def _variants(files: DataFrame) -> DataFrame:
    """(file_name, source_line_number, v): the lines that are JSON objects, as variants.

    In brackets no text can follow a record. What Spark's parser refuses (a key twice, ...) is read
    once more by the strict one and written plainly.
    """
    read = files.select("file_name", "source_line_number", "source_json").where("file_name is not null and source_json is not null")
    bracketed = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    parsed = read.withColumn("all", bracketed(F.col("source_json")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (r := loads_object(t)) is None else json.dumps(r, ensure_ascii=False) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["file_name", "source_line_number", "source_json"])

    again = parsed.where("all is null").drop("all").mapInArrow(rows, "file_name string, source_line_number long, source_json string").where("source_json is not null")
    every = parsed.where("all is not null").unionByName(again.withColumn("all", bracketed(F.col("source_json"))))
    one = every.where("try_variant_get(all, '$[1]', 'variant') is null").select("file_name", "source_line_number", F.try_variant_get("all", "$[0]", "variant").alias("v"))
    return one.where("startswith(schema_of_variant(v), 'OBJECT')")


def unify(files: DataFrame, report: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One table of all records: file_name, source_line_number and a typed column for each field of the newest schema.

    Renamed and moved fields are read from where their file has them; fields that a file doesn't
    have are null, and fields that the newest file doesn't have keep their own columns, so that no
    field is lost. A field has one type: that of the newest file that has it (text where its values
    are of several); a single value becomes a list of one where the type is a list, a list is joined where it is text; values that can't take the type are null and
    counted by conversions(). A field moved from one list into another can't be told which item it
    belongs to and is null. Lines that aren't an object are left out; repeated lines stay.
    """
    found = materialized(schema_nodes(files)) if found is None else found
    plan = Projection(report, file_order(files), found)
    taken = {"file_name", "source_line_number"}
    return _variants(files).select("file_name", "source_line_number", *[c for _, c in plan.columns(F.col("v"), {f: "" for f in plan.files}, "", taken)])


def conversions(files: DataFrame, report: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(file_name, field_path, new_path, kind, target, n): how many values of each file have another type than their column in unify()."""
    found = materialized(schema_nodes(files)) if found is None else found
    plan = Projection(report, file_order(files), found)
    rows = []
    for f in plan.files:
        for node, kinds in plan.kinds[f].items():
            path = node.replace("[]", "")
            new = plan.names[f].get(path, path)
            if not node.endswith("[]"):
                target = plan.one(plan.types(new))
                rows += [(f, path, new, k, target, n) for k, n in kinds.items() if k not in (target, "null")]
    return files.sparkSession.createDataFrame(rows, "file_name string, field_path string, new_path string, kind string, target string, n long")
