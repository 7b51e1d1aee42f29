"""Block-gzip files: splits, members cut by chance, borders of lines, broken files."""

import gzip
import random

import pytest

from helixframe.sources import block_gzip as bg
from helixframe.sources import vcf

SMALL = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}


@pytest.fixture
def small_splits(spark):
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k in SMALL:
        spark.conf.unset(k)


def packed(text, size, rng=None):
    """text in members of size bytes, or of random sizes up to size."""
    out, at = b"", 0
    while at < len(text):
        n = rng.randint(1, size) if rng else size
        out += bg.deflate(text[at : at + n])
        at += n
    return out + bg.END


def stored(text):
    """One member that holds text as it is, so that MAGIC in it stands in the file."""
    import zlib

    squeeze = zlib.compressobj(0, zlib.DEFLATED, -15)
    body = squeeze.compress(text) + squeeze.flush()
    head = bg.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little")
    return head + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def values(df):
    return sorted(bytes(r[0]) for r in df.selectExpr("CAST(value AS BINARY)").collect())


def test_lines_equal_those_of_the_plain_text(spark, tmp_path, small_splits):
    rng = random.Random(3)
    lines = [f"chr{i}\t{rng.getrandbits(200)}" for i in range(6000)] + ["", "x" * 150_000, "", "déjà", "\r", "end without a feed"]
    text = "\n".join(lines).encode()
    for name, size, r in (("a.vcf.gz", 9000, None), ("b.vcf.gz", 65_000, rng), ("c.vcf.bgz", 700, rng)):
        (tmp_path / name).write_bytes(packed(text, size, r))
        df = bg.read_lines(spark, [str(tmp_path / name)])
        assert df.rdd.getNumPartitions() > 5
        assert values(df) == sorted(line.encode().removesuffix(b"\r") for line in lines)


def test_member_starts_that_occur_by_chance(spark, tmp_path, small_splits):
    """The four bytes stand in the text, densely, so that they also fall on and beside every split's border."""
    rng = random.Random(9)
    lines = [b"".join(rng.choice([bg.MAGIC, b"abc", b"\xff\xfe", bg.MAGIC * 2]) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    text = b"\n".join(lines) + b"\n"
    (tmp_path / "a.gz").write_bytes(b"".join(stored(text[i : i + 30_000]) for i in range(0, len(text), 30_000)) + bg.END)
    assert values(bg.read_lines(spark, [str(tmp_path / "a.gz")])) == sorted(lines)


def test_other_files(spark, tmp_path):
    (tmp_path / "empty.gz").write_bytes(bg.END)
    (tmp_path / "plain.gz").write_bytes(gzip.compress(b"a\n"))
    (tmp_path / "one.gz").write_bytes(bg.deflate(b"a\n\nb") + bg.END)
    names = [str(tmp_path / n) for n in ("empty.gz", "plain.gz", "one.gz")]
    assert bg.blocked(spark, names) == [names[0], names[2]]
    assert values(bg.read_lines(spark, [names[0], names[2]])) == [b"", b"a", b"b"]
    assert values(bg.read_lines(spark, [names[0]])) == []
    assert values(vcf.text_lines(spark, str(tmp_path))) == [b"", b"a", b"a", b"b"]


def test_broken_files_are_errors(spark, tmp_path):
    whole = packed(b"line\n" * 1000, 2000)
    flipped = bytearray(whole)
    flipped[-len(bg.END) - 6] ^= 1
    for name, data in (("short.gz", whole[:-40]), ("flipped.gz", bytes(flipped))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="member|checksum|broken"):
            bg.read_lines(spark, [str(tmp_path / name)]).count()


def test_export_is_read_back_by_several_tasks(spark, tmp_path, small_splits):
    df = spark.range(3000).selectExpr("CASE WHEN id % 2 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom", "id AS start", "CAST(NULL AS STRING) AS rsid", "'A' AS ref", "'G' AS alt", "1.5D AS qual", "'' AS filter", "sha2(CAST(id AS STRING), 512) AS note")
    vcf.write_vcf(df, str(tmp_path / "whole"), compress=True)
    files = sorted((tmp_path / "whole").glob("part-*.vcf.gz"))
    assert b"".join(gzip.decompress(f.read_bytes()) for f in files).count(b"\n") == 3000 + 3  # three lines of header
    assert set(vcf.header_fields(spark, str(tmp_path / "whole"))[0]) == {"note"}
    back = vcf.read_vcf(spark, str(tmp_path / "whole"), {"note": "string"}, {})
    assert back.rdd.getNumPartitions() > len(files)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_partition_columns_stay(spark, tmp_path):
    for s in (1, 2):
        folder = tmp_path / f"sample={s}"
        folder.mkdir()
        (folder / "a.vcf.gz").write_bytes(packed(f"#CHROM\nchr{s}\t1\t.\tA\tC\t.\t.\t.\n".encode(), 9))
    (tmp_path / "sample=2" / "b.vcf").write_text("chr2\t5\t.\tA\tC\t.\t.\t.\n")
    found = vcf.read_vcf(spark, str(tmp_path), {}, {}, keep=["sample"])
    assert sorted((r["sample"], r["chrom"], r["start"]) for r in found.collect()) == [(1, "chr1", 1), (2, "chr2", 1), (2, "chr2", 5)]
