"""Masking leaves all other columns alone, whatever their names."""

from gristmill.llm import secrets

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_no_column_is_taken(spark):
    names = ["__m", "__gap", "__n", "__at", "__found", "row", "path", "a.b", "doc_id", "text", "source"]
    values = [f"kept {n}" for n in names]
    rows = []
    for text in (f'x api_key = "{KEY}" y', None, "", "plain words"):
        rows.append(tuple(text if n == "text" else v for n, v in zip(names, values, strict=True)))
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    out = secrets.mask_secrets(df)
    assert out.columns == names and out.schema == df.schema
    got = [tuple(r) for r in out.collect()]
    assert {r[9] for r in got} == {f'x api_key = "{secrets.MASK}" y', None, "", "plain words"}
    assert all(r[k] == f"kept {n}" for r in got for k, n in enumerate(names) if n != "text")
    assert secrets.mask_secrets(df.limit(0)).collect() == []
