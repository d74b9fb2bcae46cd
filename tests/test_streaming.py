"""An editor session: the last text wins, a close empties, cancelled requests go unanswered."""

import json

from factloom.streaming import editor


def message(seq, kind, path=None, version=None, text=None, request=None, line=None, character=None):
    return {"seq": seq, "kind": kind, "path": path, "version": version, "text": text, "request_id": request, "line": line, "character": character}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], editor.MESSAGES)


def test_fold_and_cancel(spark):
    one = frame(spark, [message(1, "open", "a.rb", 1, "x"), message(2, "change", "a.rb", 3, "z"), message(3, "change", "a.rb", 2, "y"), message(4, "open", "b.rb", 1, "q")])
    state = editor.fold(None, one)
    assert {r.path: r.text for r in state.filter("open").collect()} == {"a.rb": "z", "b.rb": "q"}
    two = frame(spark, [message(5, "close", "a.rb"), message(6, "change", "b.rb", 2, "r")])
    state = editor.fold(state, two)
    assert {r.path: r.text for r in state.filter("open").collect()} == {"b.rb": "r"}
    three = frame(spark, [message(7, "open", "a.rb", 1, "again")])
    assert {r.path: r.text for r in editor.fold(state, three).filter("open").collect()} == {"a.rb": "again", "b.rb": "r"}
    requests = spark.createDataFrame([("1",), ("2",)], "request_id string")
    assert [r.request_id for r in editor.pending(requests, frame(spark, [message(8, "cancel", request="1")])).collect()] == ["2"]


def test_session_publishes_each_revision(spark, tmp_path):
    folder, out = tmp_path / "in", []
    folder.mkdir()
    bad, good = "class A\n  def x; missing; end\nend\n", "class A\n  def x; end\nend\n"
    (folder / "1.json").write_text(json.dumps(message(1, "open", "a.rb", 1, bad)) + "\n")
    publish = lambda batch, rows: out.append(sorted((r.path, r.version, r.code) for r in rows.collect()))
    session = editor.Session(spark, None, publish)
    session(frame(spark, [message(1, "open", "a.rb", 1, bad)]), 0)
    session(frame(spark, [message(2, "change", "a.rb", 2, good)]), 1)
    assert out == [[("a.rb", 1, "E0101")], [("a.rb", 2, None)]]
    seen = []
    query = editor.run(spark, str(folder), str(tmp_path / "ck"), lambda b, rows: seen.extend(r.code for r in rows.collect()))
    query.awaitTermination(120)
    assert seen == ["E0101"]


def test_session_goes_on_and_answers(spark):
    """A new session of the same name finds the state of the batch before; requests see the newest texts."""
    text = "class A\n  def x(n)\n    A.new.x(1)\n    missing\n  end\nend\n"
    out, got = [], []
    publish = lambda batch, rows: out.append({(r.path, r.code) for r in rows.collect()})
    editor.Session(spark, None, publish, name="again")(frame(spark, [message(1, "open", "/p/a.rb", 1, text), message(2, "open", "/q/b.rb", 1, text)]), 0)
    later = editor.Session(spark, None, publish, lambda batch, rows: got.extend(rows.collect()), name="again", root="/p")
    asked = [message(3, "definition", "/p/a.rb", request="1", line=2, character=10), message(4, "hover", "/p/a.rb", request="2", line=2, character=6), message(5, "diagnostics", "/p/./a.rb", request="3"), message(6, "hover", "/p/a.rb", request="4", line=2, character=6), message(7, "cancel", request="4"), message(8, "open", "/p/../q/c.rb", 1, "class C; end")]
    later(frame(spark, asked), 1)
    assert out[0] == {("/p/a.rb", "E0101"), ("/q/b.rb", "E0101")} and ("/p/a.rb", "E0101") in out[1] and not any("c.rb" in p for p, _ in out[1])
    by = {r.request_id: r.answer for r in got}
    assert by["1"].endswith("A#x") and by["2"] == "A" and set(by) == {"1", "2", "3"}


def test_normal_paths(spark):
    rows = ["/a/./b//c", "/a/../../b", "a/../b/", "/", "../x"]
    df = spark.createDataFrame([(x,) for x in rows], "p string")
    got = df.select(editor.normal_path(df["p"]).alias("n"), editor.contained(df["p"], "/a/").alias("c")).collect()
    assert [(r.n, r.c) for r in got] == [("/a/b/c", True), ("/b", False), ("b", False), ("/", False), ("x", False)]
