"""Records of XML files that hold several documents."""

from pagemill.sources import files

BODY = """<?xml version="1.0"?><root>
<item id="1"><name>a &amp; b</name></item><item id='2' note="x>y"/><!-- <item id="9"><name>no</name></item> -->
<item id="3"
 ><name>c</name><itemx>q</itemx></item></root>
<?xml version="1.0"?><root><item id="4"><name>d</name></item></root><items><item id="5"/><item id="6"><name>cut off"""


def test_documents_and_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text(BODY)
    (tmp_path / "b.xml").write_text("<root/>")
    (tmp_path / "c.xml").write_text("")
    rows = files.read_xml(spark, str(tmp_path), "item", "_id bigint, name string").collect()
    assert sorted((r["_id"], r["name"]) for r in rows) == [(1, "a & b"), (2, None), (3, "c"), (4, "d"), (5, None)]
    assert files.read_xml(spark, str(tmp_path), "nothing", "_id bigint").collect() == []


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r>" + "".join(f"<i><k>{k}</k></i>" for k in range(20_000)) + "</r>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = files.read_xml(spark, str(tmp_path), "i", "k bigint")
        assert rows.rdd.getNumPartitions() > 4
        assert sorted(r.k for r in rows.collect()) == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
