"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: Column | str) -> Column:
    return F.translate(col(x), UPPER, LOWER)


def icontains(body: Column | str, needle: str) -> Column:
    """Substring test without regard to ASCII case; an empty needle is in nothing."""
    return F.contains(ascii_lower(body), ascii_lower(F.lit(needle))) if needle else F.lit(False)


def extension_of(name: Column | str) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(col(name), r"\.([^.]*)$", 1))


def sanitize_name(name: Column | str) -> Column:
    r"""Control characters and /\:*?"<>| become _."""
    return F.regexp_replace(col(name), r'[\x00-\x1f/\\:*?"<>|]', "_")


def sanitize_name_light(name: Column | str) -> Column:
    """Control characters become _, for volumes whose names allow the rest."""
    return F.regexp_replace(col(name), r"[\x00-\x1f\x7f]", "_")


def sanitize_content(data: Column | str, most: int = 256 * 1024) -> Column:
    """The first bytes of binary data as text: tab, line ends, printable ASCII and bytes from 128 stay, the rest is blank."""
    return F.regexp_replace(F.decode(F.substring(col(data), 1, most), "ISO-8859-1"), r"[^\t\n\r\x20-\x7e\x80-\xff]", " ")


def html_escape(x: Column | str) -> Column:
    # The five entities; & has to be first.
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col(x))


def csv_cell(x: Column | str) -> Column:
    """A cell for ;-separated text: formulas are defused, and cells with delimiters are quoted."""
    s = F.coalesce(col(x).cast("string"), F.lit(""))
    s = F.when(s.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike(r'[",\n;]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def format_size(x: Column | str) -> Column:
    """Bytes with two places of the unit; of two equally near values the larger one is shown."""
    n = col(x)

    def shown(power: int, unit: str) -> Column:
        whole = n.cast("double").cast("long")
        # exact: at most 37 bits, divided by a power of two
        part = F.floor(whole.bitwiseAND((1 << power) - 1) * 100 / F.lit(float(1 << power)) + 0.5).cast("long")
        return F.concat((F.shiftright(whole, power) + F.floor(part / 100)).cast("string"), F.lit("."), F.lpad((part % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, shown(10, "KB")).when(n < 1 << 30, shown(20, "MB")).otherwise(shown(30, "GB"))


def eta_clock(seconds: Column | str) -> Column:
    s = F.floor(col(seconds))
    return F.when(col(seconds) < 0, "-").otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def format_time(unix: Column | str, source: Column | str) -> Column:
    """Seconds as UTC text. Carved files carry the time of their own metadata, if any."""
    carved, at = col(source).startswith("carver"), F.date_format(F.timestamp_seconds(col(unix)), "yyyy-MM-dd HH:mm:ss")
    missing = F.when(carved, "no file system time").otherwise("-")
    return F.when(F.coalesce(col(unix), F.lit(0)) <= 0, missing).when(carved, F.concat(F.lit("EXIF "), at)).otherwise(at)


def safe_basename(path: Column | str) -> Column:
    """The last component of a path, made safe; 'recovered' if nothing is left."""
    base = sanitize_name(F.regexp_extract(col(path), r"([^/\\]*)$", 1))
    base = F.regexp_replace(base, r"^[. ]+$", "")
    return F.when(base == "", "recovered").otherwise(base)


def windows_path(path: Column | str) -> Column:
    r"""Forward slashes to backslashes, runs to one, no trailing one, lower case."""
    p = F.regexp_replace(F.lower(F.trim(col(path))), r"[/\\]+", r"\\")
    return F.regexp_replace(p, r"(?<!:)\\$", "")


def drive_letter(path: Column | str) -> Column:
    """The upper-case drive letter of a path (also of a \\\\?\\ or \\\\.\\ path); empty if there is none."""
    return F.upper(F.regexp_extract(col(path), r"^(?:\\\\[?.]\\)?([A-Za-z]):", 1))


def md5_text(x: Column | str) -> Column:
    """A 32-digit hexadecimal text in lower case; null for anything else."""
    s = F.trim(col(x))
    return F.when(s.rlike(r"^[0-9a-fA-F]{32}$"), F.lower(s))


def repaired_utf8(data: Column | str) -> Column:
    """Bytes as text; each malformed sequence becomes ?."""
    return F.replace(F.make_valid_utf8(col(data).cast("string")), F.lit("\ufffd"), F.lit("?"))


def vss_device(path: Column | str) -> Column:
    r"""The device of a path tagged /VSSn; empty if it has no tag."""
    n = F.regexp_extract(col(path), r"^/VSS(\d+)", 1)
    return F.when(n == "", "").otherwise(F.concat(F.lit("\\\\?\\GLOBALROOT\\Device\\HarddiskVolumeShadowCopy"), n))


def serial_matches(a: Column | str, b: Column | str) -> Column:
    """Whether two serial numbers are the same but for white space and case; empty ones match nothing."""
    strip = lambda x: F.upper(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+", ""))
    return (strip(a) != "") & (strip(a) == strip(b))


def volume_letter(path: Column | str) -> Column:
    """'C:' for C, c:, C:\\ and device paths of a drive; empty otherwise."""
    letter = F.upper(F.regexp_extract(F.trim(col(path)), r"^(?:\\\\[.?]\\)?([A-Za-z])(?::[/\\]?)?$", 1))
    return F.when(letter == "", "").otherwise(F.concat(letter, F.lit(":")))


def hex_text(data: Column | str) -> Column:
    return F.lower(F.hex(col(data)))


def ewf_segment(number: Column | str) -> Column:
    """The extension of an image's n-th segment: E01 to E99, then EAA, EAB and so on."""
    n = col(number)
    k = n - 100
    letter = lambda x: F.chr(F.lit(65) + x.cast("int") % 26)
    return F.when(n < 100, F.format_string("E%02d", n)).otherwise(F.concat(F.chr(F.lit(69) + F.floor(k / 676).cast("int")), letter(F.floor(k / 26)), letter(k)))
