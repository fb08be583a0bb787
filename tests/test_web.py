"""Web and binary operators on literal rows."""

from pyspark.sql import functions as F

from quillscan.operators import web


def test_content_types(spark):
    rows = [(b"PK\x03\x04aa", "Zip"), (b"\x1f\x8b\x08\x00", "Gzip"), (b"\x7fELF", "Elf"), (b"MZ\x90\x00", "Pe"), (b"%PDF-1", "Pdf"), (b"abc", "Unknown"), (b"abcd", "Unknown"), (b"\0" * 257 + b"ustar\0", "Tar"), (b"\xff\xd8\xff\xe0", "Jpeg")]
    got = spark.createDataFrame([(bytearray(b), w) for b, w in rows], "b binary, w string").select("w", web.content_type(F.col("b")).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_strings_and_zip(spark):
    row = spark.createDataFrame([(bytearray(b"\x00\xffhello world\x01abc\x02PK\x03\x04"),)], "b binary").select(web.printable_strings(F.col("b")).alias("s"), web.zip_start(F.col("b")).alias("z")).first()
    assert (row.s, row.z) == (["hello world"], 18)


def test_text_marks(spark):
    text = "var a=__webpack_require__(1);\n//# sourceMappingURL=a.js.map\n p{font-family: \"Fira Sans\", Arial, sans-serif;}"
    row = spark.createDataFrame([(text,)], "t string").select(web.bundler(F.col("t")).alias("b"), web.source_maps(F.col("t")).alias("m"), web.fonts(F.col("t")).alias("f")).first()
    assert (row.b.name, row.m, row.f) == ("Webpack + Terser", ["a.js.map"], ["Fira Sans", "Arial"])


def test_deobfuscation(spark):
    text = r"""a["\x6c\x6f\x67"]('he' + 'llo' + ' x', "é", String.fromCharCode(72, 105))"""
    assert spark.createDataFrame([(text,)], "t string").select(web.deobfuscated("t").alias("r")).first().r == "a.log('hello x', \"é\", 'Hi')"
