"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Letters with marks below U+0250 and the letters without them, by Unicode's decomposition.
MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]


def fold_marks(c: Column | str) -> Column:
    """Lower case, without diacritics on Latin letters."""
    return F.translate(F.lower(col(c)), "".join(a for a, _ in MARKED), "".join(b for _, b in MARKED))


def search_tokens(c: Column | str) -> Column:
    """Runs of letters and digits, folded: the words that full-text search knows."""
    return F.regexp_extract_all(fold_marks(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_words(c: Column | str, most: int = 24) -> Column:
    """Words of more than one character (letters, digits, underscores), the first ``most``."""
    words = F.split(col(c), r"[^\p{L}\p{N}_]+")
    return F.slice(F.filter(words, lambda w: F.length(w) > 1), 1, most)


def quoted_query(c: Column | str) -> Column:
    """The words, each quoted, joined by OR; the empty text if there are none."""
    return F.array_join(F.transform(query_words(c), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


#: What is masked in logs, in this order, and by what.
REDACTIONS = [
    (r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 ***"),
    (r"""(?i)\b((?:[A-Za-z_][A-Za-z0-9_-]*)?(?:token|secret|password|passwd|api[_-]?key|private[_-]?key|authorization))\s*[=:]\s*["']?[^\s"']{4,}""", "$1=***"),
    (r"""(\s(?:-u|--user|--password|--token)[\s=]+)[^\s"']+""", "$1***"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", "***"),
    (r"\b(?:sk_(?:live|test)_[A-Za-z0-9]{8,}|ghp_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[A-Z0-9]{16})\b", "***"),
    (r"(://[^\s/:@]+:)[^\s@/]+@", "$1***@"),
]

#: Shapes of secret values, in the order in which they are looked for.
SECRET_VALUES = [
    r"\b(?:sk|pk)-[A-Za-z0-9_-]{20,}",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}",
    r"\bglpat-[A-Za-z0-9_-]{20,}",
    r"\b[0-9]{8,10}:AA[A-Za-z0-9_-]{30,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)\b(?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/]+:[^\s@/]+@",
    r"""(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|password|passwd)\s*[:=]\s*["']?[A-Za-z0-9_\-./+]{12,}""",
]

#: Where a literal may stand in a line, best first.
LITERALS = [r"\b(?:process|import\.meta)\.env\.([A-Z][A-Z0-9_]+)", r"['\"`]([^'\"`]+)['\"`]", r"\b([A-Z][A-Z0-9_]{2,}(?:\.[A-Z][A-Z0-9_]+)*)\b(?!\.[a-z])"]


def redact(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for pattern, mask in REDACTIONS:
        out = F.regexp_replace(out, pattern, mask)
    return out


def trim_text(c: Column | str, most: int) -> Column:
    """One line, redacted, then cut."""
    return F.substring(redact(F.trim(F.regexp_replace(col(c), r"\s+", " "))), 1, most)


def secret_value(c: Column | str) -> Column:
    """The first 12 characters of the first secret found and an ellipsis, or null."""
    found = [F.nullif(F.regexp_extract(col(c), p, 0), F.lit("")) for p in SECRET_VALUES]
    return F.concat(F.substring(F.coalesce(*found), 1, 12), F.lit("…"))


def literal_of(c: Column | str) -> Column:
    """The first literal of more than one character with a letter, or the empty text."""

    def first(pattern):
        every = F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1))
        return F.get(F.filter(every, lambda x: (F.length(F.trim(x)) > 1) & x.rlike(r"\p{L}")), F.lit(0))

    return F.coalesce(*(first(p) for p in LITERALS), F.lit(""))


def skill_name(c: Column | str) -> Column:
    return F.substring_index(col(c), ":", -1)


def tokens_by_length(c: Column | str) -> Column:
    return F.floor(F.length(col(c)) / 4 + 0.5).cast("long")


def tokens_mixed(c: Column | str) -> Column:
    """Cyrillic letters at 2.2 to a token, the rest at 4."""
    cyrillic = F.regexp_count(col(c), F.lit("[Ѐ-ӿ]"))
    return F.floor(cyrillic / 2.2 + (F.length(col(c)) - cyrillic) / 4 + 0.5).cast("long")


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16LE")) / 2).cast("long")


def path_for_search(path: Column | str, text: Column | str) -> Column:
    return F.concat(F.replace(col(path), F.lit("/"), F.lit(" ")), F.lit("\n"), col(text))


def path_for_embedding(path: Column | str, text: Column | str) -> Column:
    name = F.regexp_replace(F.replace(col(path), F.lit("/"), F.lit(" / ")), "[_-]", " ")
    return F.concat(name, F.lit("\n\n"), col(text))


def project_key(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 16)


def item_digest(c: Column | str) -> Column:
    return F.substring(F.sha1(col(c)), 1, 12)


#: Commands whose failure means that the code is wrong.
CHECKS = r"\b(tsc|jest|vitest|pytest|eslint|biome|ruff|mypy|pyflakes|playwright)\b|\b(npm|pnpm|yarn|bun)\s+(run\s+)?(test|lint|typecheck|type-check|check|build)\b|\b(cargo|go)\s+test\b|\btest[-_][\w.-]+\.(mjs|cjs|js|ts|py)\b"


def is_check_command(c: Column | str) -> Column:
    return col(c).rlike(CHECKS)


def short_number(c: Column | str) -> Column:
    """Millions with two decimals and an M, thousands with one and a k, half up; below that the number itself."""
    most = F.when(col(c) >= 1e6, F.format_string("%.2fM", col(c) / 1e6))
    return most.when(col(c) >= 1000, F.format_string("%.1fk", col(c) / 1000)).otherwise(col(c).cast("long").cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 where there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0)).otherwise(F.floor(100 * part / whole + 0.5)).cast("long")


#: What JavaScript's \s and trim take as white space, for use in a character class.
SPACE = r"\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Unicode's Extended_Pictographic, which Java 17 does not name.
PICTURES = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}"
    r"\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}"
    r"\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}"
    r"\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}"
    r"\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}"
    r"\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}"
    r"\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}"
)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def prose_lines(c: Column | str) -> Column:
    """Lines outside fences, without inline code, quotes and headings, as (paragraph, line). Empty lines, fences and quotes close a paragraph."""
    start = F.struct(F.lit(False).alias("fenced"), F.lit(0).alias("paragraph"), F.array().cast("array<struct<paragraph:int,line:string>>").alias("out"))

    def step(s, line):
        fence = line.rlike(rf"^[{SPACE}]*(```|~~~)")
        plain = trim_space(F.regexp_replace(line, r"`[^`\n]*`", ""))
        closes = (trim_space(line) == "") | line.rlike(rf"^[{SPACE}]*>")
        skip = s["fenced"] | fence | closes | plain.rlike(rf"^#{{1,6}}[{SPACE}]") | (plain == "")
        return F.struct(
            F.when(fence, ~s["fenced"]).otherwise(s["fenced"]).alias("fenced"),
            F.when(fence | (~s["fenced"] & closes), s["paragraph"] + 1).otherwise(s["paragraph"]).alias("paragraph"),
            F.when(skip, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["paragraph"].alias("paragraph"), plain.alias("line"))))).alias("out"),
        )

    return F.aggregate(F.split(col(c), "\n"), start, step, lambda s: s["out"])


BEFORE, AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
QUESTION_END = rf"""\?[:!{SPACE}*_)\]»"'“”{PICTURES}\x{{FE0F}}\x{{200D}}]*\z"""
#: A question mark before a new sentence of the same line.
QUESTION_MID = rf"""\?[*_)\]»"'“”]*[{SPACE}]+\p{{Lu}}"""
#: Phrases that wait for the reader, beside the question mark.
AWAITING = (
    rf"(?iu){BEFORE}(?:как скажете|скажите|напишите|дайте знать|подтвердите|жду (?:вашего|вашей|ваш|ответа|решения|подтверждения|отмашки|команды|ок)"
    r"|если (?:согласны|хотите|не против|скажете)|если (?:нужно|надо)[^.]*могу|решать вам|на ваше усмотрение|выбор за вами"
    rf"|let me know|should i|shall i|want me to|do you want|would you like|if you(?:'d)? (?:like|want|prefer|agree)){AFTER}"
)
#: A line with this word asks for a click, not for an answer.
CLICK = rf"(?iu){BEFORE}uac{AFTER}"
#: Headings of options; list items; how many items in a row are options.
OPTIONS_HEAD = rf"(?iu)^(?:варианты|на выбор|options){AFTER}|^можно(?! было)[{SPACE}][^\n\r\x{{2028}}\x{{2029}}]+[{SPACE}]или[{SPACE}]"
LIST_ITEM = rf"^[{SPACE}]*(?:[0-9]+[.)]|[-*•]|[a-zA-Zа-яА-Я]\))[{SPACE}]+[^{SPACE}]"
LEAST_OPTIONS = 2
#: Open questions as statements, words that close them, and in how many last paragraphs they count.
OPEN = rf"(?iu){BEFORE}(?:открыт\p{{L}}*[{SPACE}]+(?:[\p{{L}}\p{{N}}]+[{SPACE}]+){{0,2}}вопрос|вопрос\p{{L}}*[{SPACE}]+(?:[\p{{L}}\p{{N}}]+[{SPACE}]+){{0,2}}открыт|open questions?{AFTER})"
CLOSED = rf"(?iu){BEFORE}(?:нет|не остал\p{{L}}*|закрыл\p{{L}}*|снят\p{{L}}*|решён|решен\p{{L}}*|none){AFTER}"
OPEN_PARAGRAPHS = 2
#: Words in quotation marks are not the writer's.
QUOTED = r"""«[^»]*»|„[^“”]*[“”]|"[^"]*"|“[^”]*”"""


def asks(line: Column) -> Column:
    """Whether a line of prose waits for an answer."""
    waits = ~line.rlike(CLICK) & F.regexp_replace(line, QUOTED, "").rlike(AWAITING)
    return line.rlike(QUESTION_END) | line.rlike(QUESTION_MID) | waits | line.rlike(OPTIONS_HEAD)


def pending_question(c: Column | str) -> Column:
    """The first line of the last paragraph that asks, else an open question of the last two, else the line that asks before a tail of list items, or null."""
    start = F.struct(F.lit(None).cast("string").alias("head"), F.lit(0).alias("items"))

    def tail(s, x):
        """The line before the list items at the end, and their number."""
        item = x["line"].rlike(LIST_ITEM)
        return F.struct(F.when(item, s["head"]).otherwise(x["line"]).alias("head"), F.when(item, s["items"] + 1).otherwise(0).alias("items"))

    def choose(lines):
        paragraphs = F.array_sort(F.array_distinct(F.transform(lines, lambda x: x["paragraph"])))
        late = F.slice(F.reverse(paragraphs), 1, OPEN_PARAGRAPHS)
        last = F.array_max(paragraphs)

        def open_(line):
            own = F.regexp_replace(line, QUOTED, "")
            return own.rlike(OPEN) & ~own.rlike(CLOSED)

        hit = F.get(F.filter(lines, lambda x: (x["paragraph"] == last) & asks(x["line"])), F.lit(0))["line"]
        still = F.get(F.filter(lines, lambda x: F.array_contains(late, x["paragraph"]) & open_(x["line"])), F.lit(0))["line"]
        options = F.aggregate(lines, start, tail, lambda s: F.when((s["items"] >= LEAST_OPTIONS) & asks(s["head"]), s["head"]))
        return F.coalesce(hit, still, options)

    return F.get(F.transform(F.array(prose_lines(c)), choose), F.lit(0))
