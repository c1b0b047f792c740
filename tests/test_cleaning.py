"""Cleaning operators (W1, C1, C2, A1, C3, M2) on the reference fixtures."""

from pyspark.sql import functions as F

from immolens.operators import clean

AGENCE_A = "926687ef88b6236575ef397b1288a2544f111bf6feca4f83956e23dd5bb2116f"


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([("1", 10, 0), ("2", 20, 1), ("2", 20, 2), ("3", 30, 3)],
                               "id_annonce string, prix int, ordinal long")
    out = clean.manage_duplicates(df)
    assert sorted(r.id_annonce for r in out.collect()) == ["1", "2", "3"]


def test_dedupe_first_in_file_order_any_partitioning(spark):
    rows = [("7", 100.0, 5), ("7", 200.0, 1), ("8", 1.0, 2), ("8", 2.0, 9)]
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "id_annonce string, prix double, ordinal long")
        out = {r.id_annonce: r.prix for r in
               clean.manage_duplicates(df.repartition(parts)).collect()}
        assert out == {"7": 200.0, "8": 1.0}


def test_dedupe_missing_column_is_noop(spark):
    df = spark.createDataFrame([(1,), (1,)], "x int")
    assert clean.manage_duplicates(df).count() == 2


def test_numeric_text(spark):
    df = spark.createDataFrame([("150 000 €", "45 m²"), ("200000", "120m2"), (" 30.5 ", "NaN")],
                               "prix string, surface string")
    out = clean.clean_numerical_columns(df, ["prix", "surface"]).collect()
    assert out[0].prix == 150000.0
    assert [r.surface for r in out] == [45.0, 120.0, None]


def test_numbers_pass_through(spark):
    df = spark.createDataFrame([(12345678.0,)], "prix double")
    assert clean.clean_numerical_columns(df, ["prix"]).first().prix == 12345678.0
    txt = spark.createDataFrame([("12 345 678 €",)], "prix string")
    assert clean.clean_numerical_columns(txt, ["prix"]).first().prix == 12345678.0


def test_normalise_text(spark):
    df = spark.createDataFrame([(" Paris ", "Appartement "), ("LYON", "maison"),
                                ("marseille ", " APPARTEMENT"), (None, None)],
                               "ville string, type_bien string")
    out = clean.normalize_text_columns(df).collect()
    assert [r.ville for r in out] == ["PARIS", "LYON", "MARSEILLE", None]
    assert [r.type_bien for r in out] == ["APPARTEMENT", "MAISON", "APPARTEMENT", None]


def test_mean_impute(spark):
    df = spark.createDataFrame([(100000.0,), (None,), (200000.0,)], "prix double")
    assert clean.impute_missing_values(df).collect()[1].prix == 150000.0


def test_mean_impute_all_null_stays_null_and_keys_untouched(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "id_annonce long, surface double")
    out = clean.impute_missing_values(df).collect()
    assert out[1].id_annonce is None and out[0].surface is None


def test_hash(spark):
    df = spark.createDataFrame([("Agence A",), (None,)], "agence string")
    out = clean.hash_contact_names(df).collect()
    assert out[0].agence == AGENCE_A and len(out[0].agence) == 64
    assert out[1].agence is None


def _chain_input(spark, with_pieces=True):
    cols = ["id", "city", "type", "price", "surface", "pieces", "author", "ordinal"]
    rows = [("id_1", " Paris ", "Appartement ", "150 000 €", "45 m²", "2", "Agence A", 0),
            ("id_2", "LYON", "maison", "350 000", "120m2", "4", "Agence B", 1)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols[:-1]) + ", ordinal long")
    return df if with_pieces else df.drop("pieces")


def test_full_chain(spark):
    out = clean.clean_listings(_chain_input(spark))
    assert "pieces" in out.columns
    rows = {r.id_annonce: r for r in out.collect()}
    assert rows["id_1"].ville == "PARIS" and rows["id_1"].prix == 150000.0
    assert rows["id_1"].agence == AGENCE_A
    assert rows["id_2"].surface == 120.0


def test_full_chain_without_pieces(spark):
    out = clean.clean_listings(_chain_input(spark, with_pieces=False))
    assert "pieces" not in out.columns
    assert out.where(F.col("id_annonce") == "id_1").first().ville == "PARIS"


def test_what_precedes_deduplication_is_done_once(spark, tmpdir_path):
    """With a store, the input is read once and the rows are those without one."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.createDataFrame(
        [(1, 0, 10.0, None, " Paris "), (1, 1, 11.0, 5.0, "Lyon"), (2, 2, None, 7.0, "Lyon"), (None, 3, 3.0, 1.0, None)],
        "id long, ordinal long, price double, surface double, city string")
    counted = rows.mapInArrow(seen, rows.schema)

    def store(name, make):
        make().write.parquet(f"{tmpdir_path}/{name}")
        return spark.read.parquet(f"{tmpdir_path}/{name}")

    got = clean.clean_listings(counted, store=store)
    assert sorted(map(str, got.collect())) == sorted(map(str, clean.clean_listings(rows).collect()))
    assert reads.value == 4
