import os
import tempfile

import pytest

from lakeprobe.sources.readers import input_bytes, load, read_csv

from .conftest import SF


def test_latin1_csv_with_null_tokens(spark):
    d = tempfile.mkdtemp(prefix="lp-csv-", dir="/tmp")
    p = os.path.join(d, "x.csv")
    with open(p, "wb") as f:
        f.write("id,name,amount,day\n1,Andr\xe9,1.5,2024-01-02\n2,NA,NA,2024-01-03\n3,Zo\xe9,,N/A\n".encode("latin-1"))
    df = load(spark, p)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "amount": "double", "day": "string"}
    rows = df.orderBy("id").collect()
    assert rows[0]["name"] == "Andr\xe9" and rows[1]["name"] is None and rows[2]["amount"] is None


def _csv(data: bytes) -> str:
    p = os.path.join(tempfile.mkdtemp(prefix="lp-csv-", dir="/tmp"), "x.csv")
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_csv_quotes_and_line_breaks(spark):
    p = _csv(b'id,t,ok\n1,"say ""hi"", ok",True\n2,"x\ny",False\n3,,\n')
    with pytest.raises(ValueError, match="multi_line"):
        read_csv(spark, p)
    df = read_csv(spark, p, multi_line=True)
    assert dict(df.dtypes) == {"id": "bigint", "t": "string", "ok": "boolean"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'say "hi", ok', True), (2, "x\ny", False), (3, None, None)]


def test_csv_encodings(spark):
    good = _csv("id,t\n1,caf\u00e9 \ufffd\n".encode())
    assert read_csv(spark, good).first()["t"] == "caf\u00e9 \ufffd"
    header = _csv("id,pr\u00e9nom\n1,a\n".encode("latin-1"))
    assert read_csv(spark, header).columns == ["id", "pr\u00e9nom"]


def test_csv_row_with_too_many_fields(spark):
    with pytest.raises(Exception, match="does not fit the header"):
        read_csv(spark, _csv(b"id,t\n1,a,b\n2,c\n")).collect()
    assert read_csv(spark, _csv(b'id,t\n1\n2,"c,d"\n')).orderBy("id").collect()[1]["t"] == "c,d"


def test_file_bytes(spark):
    from lakeprobe.operators.meta import meta_shape
    p = f"{SF}/orders.parquet"
    want = os.path.getsize(p)
    assert meta_shape(spark.read.parquet(p)).first()["bytes"] == want
    assert input_bytes(spark.read.parquet(p).repartition(3)) == want


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        load(spark, "/tmp/file.xlsx")
