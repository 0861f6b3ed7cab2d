"""Text functions: Column to Column, all inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks here, and the patterns and their order in without_dashes and without_hashtags.
DASHES = "—–‒―�"
#: Letters that no rule below takes apart, and two alphabets that are spelt in Latin letters.
SPELT = {"ß": "ss", "þ": "th", "ð": "d", "ı": "i", "ĸ": "q", "ŋ": "ng", "ſ": "s"}
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia".split(), strict=True)) | {"ъ": "", "ь": "", "ё": "io"}
SECRETS = {
    "Metricool client ID": r"client_[a-f0-9]{32}\b",
    "Anthropic API key": r"sk-ant-[A-Za-z0-9_\-]{20,}",
    "OpenAI API key": r"sk-[A-Za-z0-9]{40,}",
    "GitHub PAT": r"gh[ps]_[A-Za-z0-9]{30,}",
    "GitHub OAuth token": r"gho_[A-Za-z0-9]{30,}",
    "Slack bot/user token": r"xox[baprs]-[A-Za-z0-9\-]{10,}",
    "Stripe secret key": r"sk_live_[A-Za-z0-9]{20,}",
    "AWS access key ID": r"AKIA[0-9A-Z]{16}",
    "Bearer token": r"Bearer\s+[A-Za-z0-9._\-]{30,}",
    "Suspicious secret assignment": r"(?i)(?:password|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)\s*[=:]\s*['\"]?([A-Za-z0-9+/=_\-]{30,})['\"]?",
}
#: Endings and names of files that are never scanned for secrets: media, archives, lock files.
SKIP_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".mp4", ".mkv", ".webm", ".mov", ".wav", ".mp3", ".onnx", ".bin", ".pdf", ".zip", ".tar", ".gz")
SKIP_NAMES = (".secrets.baseline", "uv.lock", "package-lock.json", "yarn.lock")
#: Endings of an address that are kept, in the order they are looked for.
ENDINGS = (".svg", ".png", ".jpg", ".jpeg", ".webp", ".json")
#: What a caption says where no reason is given, and its call.
BLURB, CALL = "Save this for later, it lands harder the second time.", "Follow for more."
OPT_OUT = r"(?i)#\s*(pragma:\s*allowlist\s*secret|noqa:\s*secrets)\b"


@cache
def transliteration() -> dict[str, str]:
    """Small letters to ASCII, made by rule: a letter's compatibility decomposition without its marks; else, for Latin, the letter that its Unicode name starts from (``L WITH STROKE``,
    ``LIGATURE OE``); Greek and Cyrillic letters, with or without marks, are spelt. A letter that no rule takes isn't there."""
    table = dict(SPELT)
    spelt = GREEK | CYRILLIC
    for code in (*range(0xAA, 0x530), *range(0x1D00, 0x2000), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800), *range(0xFB00, 0xFB07), *range(0xFF41, 0xFF5B)):
        letter = chr(code)
        if letter in table or not letter.isalpha() or letter.lower() != letter:
            continue
        whole = letter if letter in spelt else "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)).lower()
        named = re.fullmatch(r"LATIN SMALL (?:LETTER|LIGATURE) ([A-Z]{1,2})(?: WITH .*)?", unicodedata.name(letter, ""))
        flat = "".join(table.get(c, spelt.get(c, c)) for c in whole)
        if flat.isascii() and (flat.isalnum() or letter in spelt):
            table[letter] = flat
        elif named:
            table[letter] = named[1].lower()
    return table


def ascii_letters(x: Column) -> Column:
    """Lower case, letters spelt in ASCII where transliteration() has them, marks that stand alone gone. All that is one letter for one goes in one pass."""
    table = transliteration()
    ones = {k: v for k, v in table.items() if len(v) == 1}
    none = "".join(k for k, v in table.items() if not v)
    folded = F.translate(F.regexp_replace(F.lower(x), r"[\u0300-\u036f]+", ""), "".join(ones) + none, "".join(ones.values()))
    longer: dict[str, list[str]] = {}
    for letter, spelling in table.items():
        if len(spelling) > 1:
            longer.setdefault(spelling, []).append(letter)
    for spelling, letters in longer.items():
        folded = F.regexp_replace(folded, f"[{''.join(letters)}]", spelling)
    return folded


def slug(x: Column, most: int = 60) -> Column:
    """Lower case, letters spelt in ASCII, hyphens between words, at most so many characters."""
    return F.substring(F.btrim(F.regexp_replace(ascii_letters(x), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def letters_and_digits(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def without_dashes(x: Column) -> Column:
    """Dashes between digits to hyphens, others to commas, and the spacing mended."""
    for pattern, by in (
        (rf"(?<=\d)\s*[{DASHES}]\s*(?=\d)", "-"),
        (rf"\s*[{DASHES}]\s*", ", "),
        (r"\s+([,.!?;:])", "$1"),
        (r",\s*,", ","),
        (r"(^|\n)\s*,\s*", "$1"),
        (r"[ \t]{2,}", " "),
    ):
        x = F.regexp_replace(x, pattern, by)
    return x


def without_hashtags(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?U)[ \t]*#\w[\w-]*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))


def first_line(x: Column, most: int = 100) -> Column:
    """The first line that isn't blank, trimmed."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: s != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, most)


def html(x: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def overlay(x: Column, accents: Sequence[str], color: str, upper: bool = True) -> Column:
    """Lines as HTML, accent words in a span, upper case unless it is a caption."""
    wanted = [a.strip().upper().rstrip(".,!?:;") for a in accents]

    def word(w: Column) -> Column:
        key = F.upper(F.rtrim(F.trim(w), F.lit(".,!?:;")))
        return F.when(key.isin(wanted) & (key != ""), F.concat(F.lit(f'<span class="em-{color}">'), html(w), F.lit("</span>"))).otherwise(html(w))

    def line(s: Column) -> Column:
        s = without_dashes(s)
        return F.array_join(F.transform(F.split(F.upper(s) if upper else s, " "), word), " ")

    return F.array_join(F.transform(F.split(x, "\n"), line), "<br>")


def skipped(name: Column) -> Column:
    """Whether a file of that name isn't scanned."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*SKIP_ENDINGS) | name.isin(*SKIP_NAMES)


def redacted(x: Column) -> Column:
    return F.when(F.length(x) <= 12, F.repeat(F.lit("*"), F.length(x))).otherwise(F.concat(F.substring(x, 1, 4), F.lit("..."), F.right(x, F.lit(4))))


def first_match(x: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose key the lower-cased text contains."""
    out = F.when(F.lit(False), F.lit(""))
    for key, value in rules:
        out = out.when(F.lower(x).contains(key), F.lit(value))
    return out.otherwise(F.lit(default))


def json_array_slice(x: Column) -> Column:
    """From the first [ to the last ], code fences and prose around it gone; null where there is none."""
    return F.nullif(F.regexp_extract(x, r"(?s)\[.*\]", 0), F.lit(""))


def json_object_slice(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def lookup(x: Column, pairs: Mapping[str, str], default: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, value in pairs.items():
        out = out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(default))


def human_bytes(n: Column) -> Column:
    """In the largest unit that a number reaches, with one decimal, rounded half up; GB is the last, whatever the number."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for unit, size in (("KB", 1024), ("MB", 1024**2), ("GB", 1024**3)):
        value = F.floor(n * 10 / size + 0.5)
        shown = F.concat((value / 10).cast("long").cast("string"), F.lit("."), F.pmod(value, F.lit(10)).cast("string"), F.lit(f" {unit}"))
        out = out.otherwise(shown) if unit == "GB" else out.when(n < size * 1024, shown)
    return out


def with_alpha(color: Column, alpha: Column) -> Column:
    """#rrggbb to rgba(r, g, b, alpha)."""
    part = lambda k: F.conv(F.substring(color, k, 2), 16, 10)
    return F.concat(F.lit("rgba("), part(2), F.lit(", "), part(4), F.lit(", "), part(6), F.lit(", "), alpha.cast("string"), F.lit(")"))


def cache_path(url: Column) -> Column:
    """SHA-1 of an address, and the ending that it shows before a query."""
    low, ending = F.substring_index(F.lower(url), "?", 1), F.lit("")
    for e in reversed(ENDINGS):
        ending = F.when(F.endswith(low, F.lit(e)), e).otherwise(ending)
    return F.concat(F.sha1(url), ending)


def every_string(x: str | Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """x, of a given type, with every string in it changed: in structs, arrays and the values of maps, at any depth."""
    x = F.col(x) if isinstance(x, str) else x
    if isinstance(kind, T.StringType):
        return change(x)
    if isinstance(kind, T.StructType):
        made = F.struct(*(every_string(x[f.name], f.dataType, change).alias(f.name) for f in kind.fields))
        return F.when(x.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: every_string(v, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: every_string(v, kind.valueType, change))
    return x


#: A JSON text's tokens: a string, with the colon if it names a member, or what lies between strings. Possessive, so that no long string is a deep recursion.
JSON_TOKEN = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[^"]++)"""


def every_json_string(x: Column, change: Callable[[Column], Column]) -> Column:
    """JSON text of any shape to a struct (value, changed): the text with every string in it changed, members' names aside, at any depth, all else as it was written;
    and whether one did change. Null where x is no JSON; a VARIANT goes in by to_json and out by parse_json."""

    def token(t: Column) -> Column:
        plain = F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(0))
        new = change(plain)
        quoted = F.to_json(F.array(new))
        return F.when(F.startswith(t, F.lit('"')) & ~F.endswith(t, F.lit(":")) & (new != plain), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(t)

    tokens = F.regexp_extract_all(x, F.lit(JSON_TOKEN), F.lit(1))
    made = F.struct(F.array_join(F.transform(tokens, token), "").alias("value"))
    found = F.when(F.try_parse_json(x).isNotNull(), made)
    return F.transform(F.array(found), lambda y: F.when(y.isNotNull(), F.struct(y["value"].alias("value"), (y["value"] != x).alias("changed"))))[0]


def fallback_caption(hook: Column, why: Column) -> Column:
    """Headline in upper case unless it asks, why it is worth while, and the call."""
    headline = F.when((hook != "") & ~F.endswith(hook, F.lit("?")), F.upper(hook)).otherwise(hook)
    body = F.when(F.trim(why) != "", F.trim(why)).otherwise(BLURB)
    return F.concat(headline, F.lit("\n\n"), body, F.lit(f"\n\n{CALL}"))


def with_duration(html: Column, seconds: Column) -> Column:
    """A template's length, in its attribute and its script, replaced."""
    html = F.regexp_replace(html, F.lit(r'data-duration="[\d.]+"'), F.concat(F.lit('data-duration="'), seconds, F.lit('"')))
    return F.regexp_replace(html, F.lit(r"const TOTAL = [\d.]+"), F.concat(F.lit("const TOTAL = "), seconds))


def loudness_filter(target: float, peak: float, spread: float, measured: Mapping[str, Column] | None = None) -> Column:
    """The measuring pass' filter, or the second pass' with what was measured."""
    head = F.lit(f"loudnorm=I={target}:TP={peak}:LRA={spread}:")
    if measured is None:
        return F.concat(head, F.lit("print_format=json"))
    return F.concat(head, *(F.concat(F.lit(f"{name}="), value, F.lit(":")) for name, value in measured.items()), F.lit("linear=true:print_format=summary"))
