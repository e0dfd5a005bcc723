import os
import tempfile

from pyspark.sql import functions as F

from tillscope.streaming.upload_ingest import read_landed, start_upload_ingest


def test_upload_stream_lands_files(spark):
    base = tempfile.mkdtemp(prefix="tillscope-stream-")
    up = os.path.join(base, "up")
    os.makedirs(up)
    with open(os.path.join(up, "a.csv"), "w", encoding="latin-1") as f:
        f.write("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n")
        f.write("1,A,caf\xe9 mug,2,12/1/2010 8:26,1.5,17850,United Kingdom\n")
        f.write("2,B,plate,-1,12/2/2010 9:00,2.0,17850,United Kingdom\n")
    q = start_upload_ingest(spark, up, os.path.join(base, "t"), os.path.join(base, "m"), os.path.join(base, "ck"))
    q.awaitTermination(120)
    rows = read_landed(spark, os.path.join(base, "t")).orderBy("InvoiceNo").collect()
    assert [r["Description"] for r in rows] == ["caf\xe9 mug", "plate"]
    assert rows[0]["InvoiceDate"].hour == 8 and rows[0]["line_key"] < rows[1]["line_key"]
    months = spark.read.parquet(os.path.join(base, "m")).select("period").distinct().collect()
    assert [m["period"] for m in months] == ["2010-12"]
