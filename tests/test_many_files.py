from kinloom.sources import tagged


def test_read_record_reads_every_file_with_the_key(spark, tmp_path):
    n, body = 10_050, "0 HEAD\n1 CHAR UTF-8\n"
    for i in range(n):
        (tmp_path / f"{i}.ged").write_text(body + "0 TRLR\n")
    fields = (f"concat('file:{tmp_path}/', id, '.ged') AS doc_id", "'TRLR' AS key", "true AS by_type", "'TRLR' AS type", f"{len(body)}L AS byte_offset", "7L AS byte_length")
    found = tagged.read_record(spark, spark.range(n).selectExpr(*fields), "TRLR", True).select("doc_id", "type").distinct()
    assert found.where("type = 'TRLR'").count() == n
