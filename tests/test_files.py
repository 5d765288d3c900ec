from cahier.sources import files


def test_tasks_list_the_files(spark, tmp_path):
    """src_files (F4): the names are those of Spark's reader, and the driver holds none of them."""
    for name in ("a.txt", "b/c.txt", "b/d/e.bin", "b/d/f é.txt", "_h/g.txt", "b/.h.txt", "b/_i.txt", "b/empty.txt", "k=1/_j=2.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else name)
    (tmp_path / "b/nothing").mkdir()
    for glob in ("*", "*.txt", "{a,e}*", "[^a]*.txt"):
        want = {(r["doc_id"], r["doc_name"], bytes(r["content"])) for r in files.read_files(spark, str(tmp_path), glob).collect()}
        listed = files.list_files(spark, str(tmp_path), glob)
        assert {(r["doc_id"], r["doc_name"], bytes(r["content"])) for r in files.read_listed(listed).collect()} == want
        assert {(r["doc_id"], r["length"]) for r in listed.collect()} == {(i, len(c)) for i, _, c in want}
        assert not [f for f in listed.inputFiles() if str(tmp_path) in f]
