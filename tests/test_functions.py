from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import classify, raid, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def all_of(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in rows.select("k", function(F.col("v")).alias("x")).orderBy("k").collect()]


def test_dos_times(spark):
    cases = [(0x0021, 0, 315532800), (2020, (2, 29, 12, 30, 0), 1582979400), (2024, (12, 31, 23, 59, 58), 1735689598), (1999, (9, 9, 9, 9, 8), 936868148), (0x0001, 0, 0), (13 << 5 | 1, 0, 0), (1 << 5, 0, 0)]
    rows = []
    for a, b, want in cases:
        if isinstance(b, tuple):
            month, day, hour, minute, second = b
            a, b = (a - 1980) << 9 | month << 5 | day, hour << 11 | minute << 5 | second // 2
        rows.append((a, b, want))
    got = spark.createDataFrame(rows, "d int, t int, w long").select(times.dos_to_unix("d", "t").alias("x"), "w").collect()
    assert [r.x for r in got] == [r.w for r in got]
    from lodestrata.sources.fat import dos_unix

    assert [dos_unix(a, b) for a, b, _ in rows] == [w for *_, w in rows]


def test_filetime_and_exif(spark):
    assert all_of(spark, times.filetime_to_unix, [132223104000000000, 0, 116444736000000000, 1, None], "long") == [1577836800, 0, 0, 0, 0]
    stamp = int(datetime.datetime(2021, 5, 6, 7, 8, 9, tzinfo=datetime.UTC).timestamp())
    assert all_of(spark, times.exif_to_unix, ["2021:05:06 07:08:09", "1969:01:01 00:00:00", "2021:13:01 00:00:00", "2021-05-06 07:08:09", "", "2101:01:01 00:00:00"]) == [stamp, 0, 0, 0, 0, 0]


def test_texts(spark):
    assert all_of(spark, text.extension_of, ["a.B.JPG", "none", ".hid", "end."]) == ["jpg", "", "hid", ""]
    assert all_of(spark, text.sanitize_name, ['a/b\\c:*?"<>|\x01z']) == ["a_b_c_______" + "_z"]
    assert all_of(spark, text.csv_cell, ["=1+1", "a;b", 'q"', "-x", None, "ok"]) == ["'=1+1", '"a;b"', '"q"""', "'-x", "", "ok"]
    assert all_of(spark, text.html_escape, ["<a href='x'>&\""]) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]
    assert all_of(spark, text.format_size, [0, 1023, 1024, 1536, 5 << 20, 3 << 30], "long") == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "5.00 MB", "3.00 GB"]
    assert all_of(spark, text.eta_clock, [-1.0, 0.0, 3725.9], "double") == ["-", "00:00:00", "01:02:05"]
    assert all_of(spark, text.md5_text, ["D41D8CD98F00B204E9800998ECF8427E ", "zz", None]) == ["d41d8cd98f00b204e9800998ecf8427e", None, None]
    assert all_of(spark, text.ewf_segment, [1, 99, 100, 101, 126], "int") == ["E01", "E99", "EAA", "EAB", "EBA"]
    assert all_of(spark, text.vss_device, ["/VSS3/Users", "/x"]) == ["\\\\?\\GLOBALROOT\\Device\\HarddiskVolumeShadowCopy3", ""]
    assert all_of(spark, text.volume_letter, ["c", "D:\\", "\\\\.\\E:", "foo"]) == ["C:", "D:", "E:", ""]
    assert all_of(spark, text.drive_letter, ["c:/x/y", "\\\\?\\d:\\z", "/unix"]) == ["C", "D", ""]
    assert all_of(spark, text.safe_basename, ["/a/b.txt", "C:\\x\\..", "a\\b?c"]) == ["b.txt", "recovered", "b_c"]
    assert one(spark, text.icontains(F.lit("AbC"), "bc")) is True and one(spark, text.icontains(F.lit("abc"), "")) is False
    assert one(spark, text.sanitize_content(F.lit(bytearray(b"a\x00b\xff\t\x7f")))) == "a b\xff\t "


def test_sizes_round_halves_up(spark):
    rng = random.Random(3)
    sizes = [1023, 1152, 1157, 1664, 1 << 17 | 128, (1 << 20) - 1, (1 << 20) + (1 << 17), (1 << 30) - 1, (1 << 30) + (3 << 27), 10**17 + 1, (1 << 62) + 12345]
    sizes += [rng.randrange(1 << 10, 1 << 44) for _ in range(200)] + [(1 << p) // 8 * k for p in (10, 20, 30) for k in range(8, 60)]

    def shown(n):
        if n < 1 << 10:
            return f"{n} B"
        power, unit = (10, "KB") if n < 1 << 20 else (20, "MB") if n < 1 << 30 else (30, "GB")
        h = (float(n).as_integer_ratio()[0] * 200 + (1 << power)) >> power + 1  # of two equally near hundredths the larger
        return f"{h // 100}.{h % 100:02d} {unit}"

    assert shown(1152) == "1.13 KB"
    assert all_of(spark, text.format_size, [*sizes, None], "long") == [*map(shown, sizes), None]


def test_accented_text_is_text(spark):
    plain = lambda data: tuple(one(spark, classify.preview_kind(F.lit("p"), F.lit(bytearray(data)))))
    assert plain("Éçé ab".encode() * 99) == ("binary", "") and plain(b"caf\xc3\xa9 in the morning" * 99) == ("text", "text/plain")
    kind = lambda data: tuple(one(spark, classify.preview_kind(F.lit("p"), F.lit(bytearray(data)), utf8=True)))
    for words in ("Éçé Éçé Éçé", "Straße für Öl", "ışık güneş", "текст", "文字", "😀 ok"):
        for cut in (b"", b"a", b"ab", b"abc"):  # the sample may end within a character
            assert kind(cut + (words * 200).encode()) == ("text", "text/plain")
    assert kind("Éçé".encode("latin-1") * 9) == kind("Éçé ab".encode("utf-16-le") * 9) == kind(b"\x80\x81" * 9) == kind("\u0081\u0082".encode() * 9) == ("binary", "")
    assert kind(random.Random(5).randbytes(2000)) == kind(b"") == kind(bytes(600)) == kind("\ufffd".encode() * 9) == ("binary", "")
    assert kind(b"a" * 85 + bytes(15)) == ("text", "text/plain") and kind(b"a" * 84 + bytes(16)) == ("binary", "")


def test_classification(spark):
    assert all_of(spark, classify.category_for_name, ["x.JPG", "a.mkv", "b.opus", "c.pdf", "d.7z", "e.dll", "f"]) == ["Image", "Video", "Audio", "Document", "Archive", "Executable", "Other"]
    assert all_of(spark, classify.usn_event_type, [0x80000203 - (1 << 32), 0x10000, 0x20001, 0x11, 8, 4, 1, 0x800], "long") == ["delete", "rename_old", "rename_new", "truncate", "extend", "overwrite", "create", "touch"]
    mime = lambda data: one(spark, classify.sniff_mime(F.lit(bytearray(data))))
    assert [mime(x) for x in (b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"RIFF....WEBP", b"%PDF", b"xx", b"hello")] == ["image/jpeg", "image/png", "image/gif", "image/webp", "application/pdf", "", ""]
    bmp = b"BM" + (60).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    assert mime(bmp) == "image/bmp" and mime(bmp[:14] + (41).to_bytes(4, "little")) == ""
    kind = lambda name, data: tuple(one(spark, classify.preview_kind(F.lit(name), F.lit(bytearray(data)))))
    assert kind("a.txt", b"\x89PNG\r\n\x1a\n") == ("image", "image/png") and kind("a.bmp", b"no bmp") == ("binary", "") and kind("a", b"plain text here") == ("text", "text/plain")
    assert kind("a", b"PK\x03\x04 text") == ("binary", "") and kind("a.ico", b"..") == ("image", "image/x-icon") and kind("a", b"\x00\x01\x02\x03\x04") == ("binary", "")
    health = spark.createDataFrame([(0, 0), (1, 0), (0, 2), (3, 1), (-1, None)], "r int, p int").select(classify.ata_health("r", "p").alias("x"))
    assert [r.x for r in health.collect()] == ["Good", "Warning", "Warning", "Bad", "Good"]
    assert one(spark, classify.refined_category(F.lit("Unknown"), F.lit(".BIN"), F.lit(7.9), F.lit(10))) == "Encrypted"
    assert one(spark, classify.refined_category(F.lit(""), F.lit("xyz"), F.lit(3.0), F.lit(90))) == "Text"
    assert one(spark, classify.refined_category(F.lit("Image"), F.lit("txt"), F.lit(7.9), F.lit(90))) == "Image"
    assert one(spark, classify.nvme_health(F.lit(0), F.lit(5), F.lit(10), F.lit(3))) == "Warning"


@pytest.mark.parametrize("disks", [3, 4, 5, 8])
def test_raid5_layout_is_a_permutation(spark, disks):
    rows = spark.range(2 * disks).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(disks - 2))))
    got = rows.select("id", raid.raid5_parity(F.col("id"), disks).alias("p"), raid.raid5_data(F.col("id"), F.col("b"), disks).alias("d")).collect()
    for s in range(2 * disks):
        mine = [r for r in got if r.id == s]
        assert sorted({r.d for r in mine} | {mine[0].p}) == list(range(disks)) and mine[0].p == disks - 1 - s % disks


def test_raid6_layout_is_a_permutation(spark):
    rows = spark.range(12).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(3))))
    got = rows.select("id", raid.raid6_p(F.col("id"), 6).alias("p"), raid.raid6_q(F.col("id"), 6).alias("q"), raid.raid6_data(F.col("id"), F.col("b"), 6).alias("d")).collect()
    for s in range(12):
        mine = [r for r in got if r.id == s]
        assert sorted({r.d for r in mine} | {mine[0].p, mine[0].q}) == list(range(6))
    assert raid.capacity(5, 4, 10) == 30 and raid.capacity(6, 5, 10) == 30 and raid.capacity(10, 4, 10) == 20
    with pytest.raises(ValueError):
        raid.check(10, 5)


def test_sql_functions(spark):
    from lodestrata.functions.binary import register

    register(spark)
    got = spark.sql("SELECT byte_entropy(X'61626162') AS e, crc32c(CAST('123456789' AS BINARY)) AS c, score_pdf(CAST('%PDF-1.4 1 0 obj %%EOF' AS BINARY)) AS s, utf16_text(X'41004200') AS u").first()
    assert tuple(got) == (1.0, 0xE3069283, 90, "AB")
