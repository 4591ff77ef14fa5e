"""Tools by name."""

import pytest

from corpuscle.engine import Engine, UnknownTool, register_functions


def test_tools(spark, sf):
    engine = Engine(spark, sf, "src1")
    listed = engine.call("list_files").collect()
    assert listed and {r["user_id"] for r in listed} == {"src1"}
    assert [r["uploaded_at"] for r in listed] == sorted((r["uploaded_at"] for r in listed), reverse=True)
    page = engine.call("get_file_content", file_id=listed[0]["file_id"], offset=5, limit=1).first()
    assert len(page["content"]) <= 100
    hits = engine.call("search_knowledge", query="the of and", n=3).collect()
    assert 0 < sum(r["kind"] == "file" for r in hits) <= 3
    assert engine.call("explore_graph", node="o1", depth=1).count() > 1
    with pytest.raises(UnknownTool):
        engine.call("nothing")


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("select search_chunks('short text') c, html_text('<b>x</b>') h").first() == (["short text"], "x")


#: What each tool is called with.
CALLS = {
    "get_file_content": {"file_id": 3}, "get_file_link": {"file_id": 3}, "get_file_summary": {"file_id": 3}, "export_file_to_chat": {"file_id": 3}, "upload_text": {"file_id": 9999, "filename": "a.txt", "content": "new text"},
    "delete_file": {"file_id": 3}, "reprocess_file": {"file_id": 3}, "update_file_tags": {"file_id": 3, "tags": [" Solar", "x"]}, "get_context_pack": {"pack_id": 2}, "create_context_pack": {"title": "p", "file_ids": [1, 2, 3, 4, 5]},
    "delete_pack": {"pack_id": 2}, "search_knowledge": {"query": "the of", "n": 3}, "auto_context": {"words": "e"}, "save_context": {"memory_id": "m", "title": "t", "content": "c"}, "update_context": {"memory_id": "1-0", "title": "t"},
    "delete_context": {"memory_id": "1-0"}, "add_note": {"node": "n1", "label": "note"}, "update_profile": {"goals": "g", "type_code": "none"},
}


def test_no_tool_shows_another_tenant(spark, sf):
    """Every tool for two tenants: no row names the other one, and what isn't a tenant's own can't be had by its id."""
    skipped = {"detect_intent", "explore_graph", "find_duplicates"}
    for name in sorted(Engine(spark, sf).tools().keys() - skipped):
        rows = {u: Engine(spark, sf, u).call(name, **CALLS.get(name, {})).collect() for u in ("src1", "src2")}
        for user, found in rows.items():
            named = {r["user_id"] for r in found if "user_id" in r}
            assert named <= {user, None}, (name, named)
        if name in ("list_files", "build_context", "list_contexts", "list_context_packs", "list_suggestions", "build_graph", "load_context"):
            assert rows["src1"] != rows["src2"] and rows["src1"], name
    owner = Engine(spark, sf, "src1").call("list_files").first()["file_id"]
    assert Engine(spark, sf, "src2").call("get_file_content", file_id=owner).count() == 0
    own = {r["node"] for r in Engine(spark, sf, "src1").call("explore_graph").collect()}
    other = {r["node"] for r in Engine(spark, sf, "src2").call("explore_graph").collect()}
    assert {n for n in own if n.startswith("o")}.isdisjoint(n for n in other if n.startswith("o"))
    assert Engine(spark, sf, "src2").call("explore_graph", node=next(n for n in own if n.startswith("o"))).count() == 0
