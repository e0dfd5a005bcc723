import random

from pyspark.sql import functions as F

from tillscope.operators import cancellation as C
from tillscope.operators.cleaning import dedup_lines
from tillscope.schema import INVOICE_COLUMNS
from tillscope.sources.invoice_csv import read_invoices
from tillscope.streaming.clean_stream import CleanStream, read_batch

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def drops(seed=3, files=3, rows=120):
    rnd = random.Random(seed)
    out, old = [], []
    for f in range(files):
        lines = []
        for i in range(rows):
            q = rnd.choice([1, 2, 5, 9]) * rnd.choice([1, 1, -1])
            c = rnd.choice(["7", "8", "9", f"1{f}", ""])
            lines.append(f"{f}{i},{rnd.choice('AB')},caf\xe9,{q},{rnd.randrange(1, 13)}/{rnd.randrange(1, 28)}/2010 8:{rnd.randrange(10, 59)},1.5,{c},UK\n")
        out.append(lines + rnd.sample(lines, 10) + (rnd.sample(old, 15) if old else []))   # repeats of this file and of earlier ones
        old += lines
    return out


def content(df):
    return sorted(str(tuple(r)) for r in df.select(*INVOICE_COLUMNS, "QuantityCanceled", "TotalPrice").collect())


def test_stream_equals_the_batch(spark, tmp_path):
    up, all_ = tmp_path / "up", tmp_path / "all"
    up.mkdir()
    all_.mkdir()
    s = CleanStream(spark, str(tmp_path / "tables"), shards=4)
    files = drops()
    files[2] += ["late1,A,caf\xe9,50,1/1/2010 8:00,1.5,7,UK\n", "late2,A,caf\xe9,-40,12/30/2010 8:00,1.5,7,UK\n"]   # hits a line of the same drop
    files.append(["late3,A,caf\xe9,-45,12/31/2010 9:00,1.5,7,UK\n"])                                          # a late cancellation of an earlier one
    for i, lines in enumerate(files):
        for folder in (up, all_):
            (folder / f"f {i}.csv").write_text(HEADER + "".join(lines), "latin-1")
        s.start(str(up), str(tmp_path / "ck")).awaitTermination(300)
        batch = dedup_lines(read_invoices(spark, str(all_), strict=False), key_in_data=False)
        assert content(s.clean()) == content(C.clean_lines(batch)), i
    # an epoch that runs again changes nothing
    before = content(s.clean())
    s.land(read_batch(spark, [str(up / f"f {len(files) - 1}.csv")]), len(files) - 1)
    assert content(s.clean()) == before
    # only customers of the last drop were matched again
    touched = s._table("touched").where(F.col("epoch") == len(files) - 1)
    assert [r["CustomerID"] for r in touched.collect()] == ["7"]
    s.compact(len(files) - 1)
    assert content(s.clean()) == before


def test_a_broken_file_does_not_stop_the_stream(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.csv").write_text(HEADER + "1,A,mug,2,12/1/2010 8:26,1.5,7,UK\n", "latin-1")
    (up / "b.csv").write_text(HEADER + "2,A,mug,many,never,1.5,7,UK\n3,A\n", "latin-1")
    (up / "c.csv").write_text("CustomerID," + HEADER.replace("CustomerID,", "") + "9,4,A,plate,1,12/2/2010 8:26,1.5,UK\n", "latin-1")
    s = CleanStream(spark, str(tmp_path / "tables"))
    s.start(str(up), str(tmp_path / "ck"), files=2).awaitTermination(300)
    rows = {r["InvoiceNo"]: r for r in s.clean().collect()}
    assert set(rows) == {"1", "2", "4"} and rows["2"]["Quantity"] is None and rows["4"]["CustomerID"] == "9"
