"""Operators on small views: worked examples, identities and edge cases."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rowloom import OPERATORS, Registry, View, operator
from rowloom.functions import schema
from rowloom.operators.lookup import strlookup
from rowloom.operators.position import omitmap, resolve
from rowloom.operators.select import glob_pattern
from rowloom.sources import tables
from rowloom.sources.filetree import tree

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def letters(spark, text="abcdef"):
    return tables.define(spark, "A", list(text))


def nested(rows, places):
    """Nested rows as plain tuples."""
    return [tuple([tuple(x) for x in c] if i in places else c for i, c in enumerate(r)) for r in rows]


# -- schema


def test_descriptors():
    assert schema.mdesc("A,B:I,C[D:L,E]") == schema.mdef(["A", "B:I", ("C", ["D:L", "E"])])
    assert schema.desc_of(schema.mdesc("A,B:I,C[D:L,E]")) == "A,B:I,C[D:L,E]"
    assert schema.letters_of(schema.mdesc("dirs[name,parent:I,files[name,size:I,date:I,contents:B]]")) == "(SI(SIIB))"
    for bad in ("A]", "A[B", "A,,B", "A,", "[A]"):
        with pytest.raises(ValueError, match="invalid view"):
            schema.mdesc(bad)
    with pytest.raises(ValueError, match="unknown type"):
        schema.mdef("A:Q")


def test_meta_and_names(spark):
    v = tables.define(spark, ["A", "B:I", ("C", ["D:L"])], ["x", 1, [(2,)]])
    assert v.meta().rows() == [("A", "S", ""), ("B", "I", ""), ("C", "V", "D:L")]
    assert (v.names, schema.names(v), v.width) == (("A", "B", "C"), ["A", "B", "C"], 3)
    assert OPERATORS["types"](v) == ["S", "I", "V"] and v.structure() == "SI(L)" and v.structdesc() == "A,B:I,C[D:L]"
    assert v.compat(tables.define(spark, ["x", "y:I", ("z", ["w:L"])], [])) and not v.compat(letters(spark))
    assert v.namecol().rows() == [("A",), ("B",), ("C",)]


def test_define_checks_items(spark):
    with pytest.raises(ValueError):
        tables.define(spark, "A,B:I", ["x", 1, "y"])
    with pytest.raises(ValueError):
        tables.define(spark, "A:I", ["1.5"])
    with pytest.raises(ValueError):
        tables.define(spark, "A:I", [1 << 40])
    with pytest.raises(ValueError):
        tables.data(spark, "A,B", ["x"], ["y", "z"])
    assert tables.data(spark, "A,B:I", ["x", "y"], [1, 2]).rows() == [("x", 1), ("y", 2)]
    assert tables.coerce(spark, ["1", "2"], "I").rows() == [(1,), (2,)]
    assert tables.define(spark, "A:I", []).rows() == []


def test_repeated_and_case_differing_names(spark):
    v = tables.define(spark, "A,a:I", ["x", 1]).colmap(["A", "a", "A"])
    assert v.names == ("A", "a", "A") and v.rows() == [("x", 1, "x")]
    assert v.unique().rows() == v.sort().rows() == [("x", 1, "x")]


# -- columns


def test_column_operators(spark):
    v = tables.define(spark, "A,B:I", ["x", 1, "y", 2])
    assert v.colmap([-1, 0]).rows() == [(1, "x"), (2, "y")]
    assert v.colmap([]).df.count() == 2 and v.colmap([]).rows() == [(), ()]
    assert v.rename("A", "B", "B", "A").names == ("B", "A")
    with pytest.raises(ValueError):
        v.rename("A")
    with pytest.raises(KeyError):
        v.colmap(["C"])
    assert v.getcol("A") == ["x", "y"] and v.viewascol() == [["x", "y"], [1, 2]]
    assert v.pair(tables.define(spark, "C", list("abc"))).rows() == [("x", 1, "a"), ("y", 2, "b")]
    assert letters(spark).pair(tables.countview(spark, 2)).rows() == [("a",), ("b",)]
    assert v.transpose("c").rows() == [("x", "y"), ("1", "2")]


# -- positions


@few
@given(st.integers(0, 7), st.integers(0, 5), st.integers(-9, 9), st.integers(1, 3), st.integers(-4, 4))
def test_step(spark, n, count, offset, rate, by):
    items = list(range(n))
    want = [items[(offset + (r // rate) * by) % n] for r in range(count * rate)] if n else []
    assert [r[0] for r in tables.iota(spark, n).step(count, offset, rate, by).rows()] == want


def test_positions(spark):
    v = letters(spark)
    take = lambda w: "".join(r[0] for r in w.rows())
    assert take(v.first(9)) == "abcdef" and take(v.first(2)) == "ab" and take(v.last(2)) == "ef" and take(v.first(0)) == ""
    assert take(v.take(8)) == "abcdefab" and take(v.take(-8)) == "fedcbafe"
    assert take(v.slice(1, 2, 5)) == "bdfbd" and take(v.reverse()) == "fedcba"
    assert take(v.reverse().first(2)) == "fe" and take(v.reverse().reverse()) == "abcdef"
    assert take(v.first(2).repeat(2)) == "abab" and take(v.first(2).spread(2)) == "aabb" and take(v.spread(0)) == ""
    assert take(v.remap([5, 0, -1, 0])) == "faaa"
    assert take(v.remap(tables.define(spark, "i:I", [5, 0, -1, -2, -1]))) == "fa" + "aaa"
    assert resolve([5, 0, -1, -2]) == [5, 0, 0, 0]
    assert take(v.remapsub([3, 2, 1], 1, 2)) == "cb"
    assert [r[0] for r in omitmap(spark, [3, 1, 3], 5).rows()] == [0, 2, 4]
    assert v.tag("N").rows()[:2] == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError):
        v.first(-1)
    with pytest.raises(IndexError):
        v.remap([-1])


def test_numbers_are_contiguous_over_partitions(spark):
    v = View.of(spark.range(0, 5000, 1, 7).withColumn("x", F.col("id") * 7 % 5000), ["x"])
    assert [r[1] for r in v.tag("n").sorted_frame().select("x", "n").collect()] == list(range(5000))
    assert v.sorton("-", "x").tag("n").where("n = 0").frame().first()["x"] == 4999


# -- nesting


def join_views(spark):
    left = tables.define(spark, "A,B,C", list("acdaefecdade"))
    right = tables.define(spark, "B,C,D", list("cdecdfdef"))
    return left, right


def test_joins(spark):
    left, right = join_views(spark)
    assert left.ijoin(right).rows() == [("a", "c", "d", "e"), ("a", "c", "d", "f"), ("e", "c", "d", "e"), ("e", "c", "d", "f"), ("a", "d", "e", "f")]
    joined = left.join(right, "R")
    assert nested(joined.rows(), {3}) == [("a", "c", "d", [("e",), ("f",)]), ("a", "e", "f", []), ("e", "c", "d", [("e",), ("f",)]), ("a", "d", "e", [("f",)])]
    assert joined.counts("R").rows() == joined.freeze().counts("R").rows() == [(2,), (0,), (2,), (1,)]
    assert joined.ungroup("R").rows() == joined.freeze().ungroup("R").rows() == left.ijoin(right).rows()
    a, b = tables.define(spark, "A", list("abc")), tables.define(spark, "B", list("xy"))
    assert a.ijoin(b).rows() == a.product(b).rows() == [(x, y) for x in "abc" for y in "xy"]
    assert nested(a.join(b, "R").rows(), {1})[0] == ("a", [("x",), ("y",)])
    assert a.join(tables.define(spark, "A:I", []), "R").counts("R").rows() == [(0,)] * 3  # other type: no shared column


def test_keys_need_name_and_type(spark):
    a, b = tables.define(spark, "K,V:I", ["1", 5]), tables.define(spark, "K:I,W", [1, "w"])
    assert a.ijoin(b).names == ("K", "V", "K", "W") and a.ijoin(b).rows() == [("1", 5, 1, "w")]


def test_groups(spark):
    v = tables.define(spark, "A,B:I", ["a", 0, "b", 1, "a", 2, "c", 1, "b", 0])
    g = v.group(["A"], "G")
    assert nested(g.rows(), {1}) == [("a", [(0,), (2,)]), ("b", [(1,), (0,)]), ("c", [(1,)])]
    assert nested(v.reverse().group(["A"], "G").rows(), {1})[0] == ("b", [(0,), (1,)])
    assert g.with_counts("n").rows() == [("a", 2), ("b", 2), ("c", 1)]
    assert g.ungroup("G").rows() == g.freeze().ungroup("G").rows() == [("a", 0), ("a", 2), ("b", 1), ("b", 0), ("c", 1)]
    assert v.group_aggregate(["A"], s=F.sum("B")).rows() == [("a", 2), ("b", 1), ("c", 1)]
    assert v.group([], "G").counts("G").rows() == [(5,)] and v.clone().group([], "G").rows() == []
    whole = v.group(["A", "B"], "G")
    assert whole.rows()[0] == ("a", 0, 1) and len(whole.freeze().ungroup("G").rows()) == 5  # nested views without columns are counts
    assert nested(letters(spark).grouped([2, 2, 5], [4, 3, 2, 1, 0], "G").rows(), {0}) == [([("e",), ("d",)],), ([],), ([("c",), ("b",), ("a",)],)]


def test_blocked(spark):
    blocks = tables.define(spark, [("b", ["k:I"])], [[(0,), (1,)], [(3,)], [(5,), (6,)], [(2,), (4,)]])
    assert [r[0] for r in blocks.blocked().rows()] == [0, 1, 2, 3, 4, 5, 6]


# -- sets


def test_set_operators_keep_duplicates(spark):
    v, w = letters(spark, "abbc"), letters(spark, "bddb")
    take = lambda x: "".join(r[0] for r in x.rows())
    assert take(v.intersect(w)) == "bb" and take(OPERATORS["except"](v, w)) == "ac" and take(v.union(w)) == "abbcdd"
    assert take(v.concat(w)) == "abbcbddb" and take(v.concat(w).unique()) == "abcd"
    assert [r[0] for r in v.isectmap(w).rows()] == [1, 2] and [r[0] for r in v.exceptmap(w).rows()] == [0, 3]
    assert [r[0] for r in v.unionmap(w).rows()] == [1, 2] and [r[0] for r in v.uniquemap().rows()] == [0, 1, 3]
    with pytest.raises(ValueError, match="invalid view"):
        v.union(tables.define(spark, "A:I", [1]))
    assert v.freq("n").rows() == [("a", 1), ("b", 2), ("c", 1)]
    assert tables.countview(spark, 3).unique().df.count() == 1 and tables.countview(spark, 0).unique().df.count() == 0


@few
@given(st.lists(st.integers(0, 3), max_size=6), st.lists(st.integers(0, 3), max_size=6))
def test_set_identities(spark, a, b):
    v, w = tables.define(spark, "A:I", a), tables.define(spark, "B:I", b)
    assert [r[0] for r in v.union(w).rows()] == a + [x for x in b if x not in a]
    assert v.intersect(w).df.count() + OPERATORS["except"](v, w).df.count() == len(a)


def test_nulls_equal_each_other(spark):
    v = View.of(spark.createDataFrame([(1, None), (2, "x")], "i int, a string"), ["i"], ["a"])
    assert v.intersect(v).rows() == [(None,), ("x",)] and v.unique().df.count() == 2


# -- sorting, aggregates, expressions


def test_sorting(spark):
    v = tables.define(spark, "A,B:I", ["b", 1, "a", 2, "b", 0, "a", 1])
    assert v.sort().rows() == [("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert v.sorton("A").rows() == [("a", 2), ("a", 1), ("b", 1), ("b", 0)]
    assert v.sorton("-", "A", "+", "B", "A").rows() == [("b", 0), ("b", 1), ("a", 1), ("a", 2)]
    assert [r[0] for r in v.sortmap().rows()] == [3, 1, 2, 0]


def test_comparing(spark):
    v, w = tables.define(spark, "A,B:I", ["a", 1, "b", 2]), tables.define(spark, "A,B:I", ["a", 1, "c", 0])
    assert (v.compare(w), w.compare(v), v.compare(v)) == (-1, 1, 0)
    assert v.compare(v.first(1)) == 1 and v.compare(v.rename("A", "Z")) != 0
    assert v.rowcmp(0, w, 0) == 0 and v.rowcmp(1, w, -1) == -1 and v.roweq(0, w, 0) and not v.roweq(1, w, 1)


def test_aggregates(spark):
    v = tables.define(spark, "A:I,B:D,C", [1, 0.5, "x", 3, 1.5, "y"])
    assert (OPERATORS["max"](v, "A"), OPERATORS["min"](v, "C"), OPERATORS["sum"](v, "A"), OPERATORS["sum"](v, "B")) == (3, "x", 4, 2.0)
    assert OPERATORS["sum"](v.clone(), "A") == 0
    with pytest.raises(ValueError, match="at least one row"):
        OPERATORS["max"](v.clone(), "A")
    with pytest.raises(TypeError):
        OPERATORS["sum"](v, "C")


def test_expressions(spark):
    v = tables.define(spark, "A,B:I", ["a", 1, "b", 2, "c", 3])
    assert v.where("B > 1 AND `#` < 2").rows() == [("b", 2)] and v.where(F.col("B") == 3).rows() == [("c", 3)]
    assert [r[0] for r in v.index("B <> 2").rows()] == [0, 2] and v.collect("B * 10 + `#`") == [10, 21, 32]
    assert v.pick([1, 0]).rows() == [("a", 1), ("c", 3)]
    seen = v.loop(lambda r: (r["#"], r["A"]), where="B < 3")
    assert seen == [(0, "a"), (1, "b")] and v.loop(lambda r: r["A"], first=0, limit=3, step=2) == ["a", "c"]


def test_filters_reach_the_files(spark, tmp_path):
    v = tables.define(spark, "A,B:I", ["a", 1, "b", 2])
    v.save(str(tmp_path / "v"))
    plan = tables.load(spark, str(tmp_path / "v")).where("B > 1").onecol("B").lineage()
    assert "GreaterThan(B,1)" in plan and "ReadSchema: struct<B:int" in plan


# -- storing, changing, names


def test_save_and_load(spark, tmp_path):
    v = tables.define(spark, ["A", "a:I", ("C", ["D:L"])], ["x", 2, [(1,), (2,)], "y", 1, []]).colmap([0, 1, 2, 0]).sorton("-", "a")
    assert v.save(str(tmp_path / "v")) == 2
    assert tables.same_rows(tables.open_views(spark, str(tmp_path), ["v"])["v"], v)


def test_emit_and_receive(spark):
    v = tables.define(spark, ["A", "A", ("C", ["D:L"])], ["x", "y", [(1,), (2,)], "z", "w", []]).reverse()
    assert tables.same_rows(tables.receive(spark, v.emit()), v)
    assert tables.receive(spark, tables.countview(spark, 7).emit()).size() == 7
    assert letters(spark).colconv().getcol(0)[0] == "a"
    with pytest.raises(ValueError):
        v.colconv()


def test_changes(spark):
    v = tables.define(spark, "A,B:I", ["a", 0, "b", 1, "c", 2, "d", 3])
    assert v.set(-1, "A", "z", "B", 9).rows()[-1] == ("z", 9) and v.rows()[-1] == ("d", 3)
    assert v.delete(1, 2).getcol("A") == ["a", "d"] and v.insert(1, v.first(1)).getcol("A") == list("aabcd")
    assert v.replace(1, 2, v.last(1)).getcol("A") == list("add") and v.append(v.first(1)).getcol("A") == list("abcda")
    with pytest.raises(ValueError):
        v.set(0, "A")
    edited = v.delete(0, 1).set(1, "A", "C").insert(1, tables.define(spark, "x,y:I", ["n", 7])).append(v.first(1))
    assert edited.rows() == [("b", 1), ("n", 7), ("C", 2), ("d", 3), ("a", 0)]
    assert v.loadmods(edited.emitmods(v)).rows() == edited.rows()
    assert v.emitmods(v).count() == 0
    info = edited.mutinfo(v)
    assert info["deleted"].rows() == [(1,), (0,), (0,), (0,)] and info["reverse"].rows() == [(1,), (-1,), (2,), (3,), (-1,)]
    assert info["used"].rows() == [(1, 0)] and info["new"].rows() == [(0,), (1,), (0,), (0,), (1,)]


@few
@given(st.lists(st.tuples(st.sampled_from(["set", "delete", "insert"]), st.integers(0, 3)), max_size=4))
def test_change_sets_replay(spark, edits):
    base = letters(spark, "abcd")
    v, want = base, list("abcd")
    for kind, at in edits:
        at = min(at, max(0, len(want) - 1))
        if kind == "set" and want:
            v, want[at] = v.set(at, "A", "S"), "S"
        elif kind == "delete" and want:
            v = v.delete(at, 1)
            del want[at]
        elif kind == "insert":
            v = v.insert(at, letters(spark, "xy"))
            want[at:at] = "xy"
    assert v.getcol("A") == want and base.loadmods(v.emitmods(base)).getcol("A") == want


def test_registry(spark):
    r = Registry()
    r.to("v", letters(spark))
    r.to("w", lambda: r.ref("v").first(2))
    assert r.ref("w").getcol("A") == ["a", "b"] and r.deps("v") == ["w"]
    r.to("v", letters(spark, "zyx"))
    assert r.ref("w").getcol("A") == ["z", "y"] and r.views() == ["v", "w"]
    assert r.resolve("v!1.A") == "y" and r.resolve("v!-1") == ("x",)
    assert r.bind("b", letters(spark))(("first", 1), ("getcol", "A")) == ["a"]
    assert r.publish("w").count() == 2 and spark.sql("SELECT count(*) FROM w").first()[0] == 2
    r.to("loop", lambda: r.ref("loop"))
    with pytest.raises(ValueError):
        r.ref("loop")
    with pytest.raises(KeyError):
        r.ref("nothing")

    @operator
    def twice(v, n):
        return v.repeat(2 * n)

    assert letters(spark, "ab").twice(1).getcol("A") == list("abab")
    assert letters(spark).do(["# a comment", ("first", 3), "reverse", ("getcol", 0)]) == list("cba")
    said = []
    letters(spark).debug([("first", 3), "?"], said.append)
    assert said[0].startswith("3 rows, 1 cols") and "a" in said[1]
    del OPERATORS["twice"]


def test_lists_and_lookups(spark):
    bits = lambda xs: [r[0] for r in tables.define(spark, "b:I", xs).bitruns("b").rows()]
    assert bits([0, 0, 1, 1, 1, 0]) == [0, 2, 3, 1] and bits([1]) == [1, 1] and bits([]) == []
    resized = lambda n: [r[0] for r in tables.define(spark, "b:I", [1, 2, 3]).resizecol(1, n).rows()]
    assert resized(2) == [1, 0, 0, 2, 3] and resized(-1) == [1, 3]
    assert strlookup(spark, "b", ["a", "b"]) == 1 and strlookup(spark, "x", []) == -1 and letters(spark).lookup("A", "c") == 2
    v = letters(spark, "abca")
    assert v.hashfind(3, v) == 0 and v.hashfind(0, letters(spark, "xyz")) == -1 and v.rowhash(0) == v.rowhash(3) != v.rowhash(1)
    assert v.getinfo().rows() == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 0, 1)] and v.getinfo(letters(spark, "xb")).rows() == [(1, 1, 0)]
    assert v.hashcol("A").df.count() == 4


def test_select(spark):
    v = tables.define(spark, "N,K:I", ["Bud light", 2, "mickies", 1, "bud", 1, "sam adams", 2])
    at = lambda *a, **b: [r[0] for r in v.select(*a, **b).rows()]
    assert at([("exact", "N", "bud")]) == [2] and at([("glob", "N", "?ud*")]) == [0, 2] and at([("globnc", "N", "BUD*")]) == [0, 2]
    assert at([("keyword", "N", "ad")]) == [3] and at([("exact", ["K"], 1), ("glob", "N", "*i*")]) == [1]
    assert at(sort=["K", "N"]) == [2, 1, 0, 3] and at(rsort=["K"]) == [3, 0, 2, 1] and at(sort=["K"], first=1, count=2) == [2, 0]
    assert glob_pattern("a[b-d]?\\*") == "(?s)^a[b-d].\\*$"


def test_rendering(spark):
    v = tables.define(spark, ["A", "B:I", ("C", ["D:I"]), "E:B"], ["x<y", 10, [(1,), (2,)], b"abc"])
    text = v.dump()
    assert "#2" in text and "3b" in text and "x<y" in text and "  ..." in letters(spark).dump(3)
    assert "x&lt;y" in v.html() and v.html().count("<table>") == 2
    assert v.get() == v.get("*")[0:1][0:0] + list(v.rows()[0]) and v.get("#") == 1 and v.get(0, "A") == "x<y" and v.get(-1, "C", 1, "D") == 2 and v.get("A") == ["x<y"]
    assert v.get("@", "name") == ["A", "B", "C", "E"] and v.lengths("C") == [2]
    with pytest.raises(IndexError):
        v.get(5)


def test_file_trees(spark):
    import zlib

    rows = [("a.txt", 3, 1, b"abc"), ("d/e/b.txt", 6, 2, zlib.compress(b"xxxxxx" )), ("d/c.txt", 0, 3, b"")]
    dirs = tree(spark.createDataFrame(rows, "path string, size int, date int, contents binary"))
    back = {r.path: bytes(r.contents) for r in dirs.files().collect()}
    assert back == {"a.txt": b"abc", "d/e/b.txt": b"xxxxxx", "d/c.txt": b""}


def test_streamed_changes(spark, tmp_path):
    from rowloom.streaming.changes import follow, start, version

    base = letters(spark, "abcd")
    start(base, str(tmp_path / "s"))
    one = base.delete(0, 1).set(0, "A", "B")
    one.emitmods(base).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, at long, c0 string").parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination(120)
    assert version(spark, str(tmp_path / "s"), 1).getcol("A") == one.getcol("A") == ["B", "c", "d"]
