"""Lines of code that link places: events, keys of stores, switches and entries from outside.

A file's lines are read where the file is: the symbol below a decorator is looked for in the
next six lines of the same row, so nothing is shuffled until lines are grouped by literal.

Cases: null texts and paths give no lines; a line of several kinds counts in each; repeated
rows count again; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.grants import once
from spanloom.functions.text import SPACE, literal_of


@dataclass(frozen=True)
class Kind:
    """A kind of link: strings that give a line away, a pattern that it must match, ones that it must not, and one that what begins at ``at`` must not."""

    name: str
    queries: tuple[str, ...]
    needs: str = ""
    never: str = ""
    at: str = ""
    not_there: str = ""
    grouped: bool = True

    def test(self, line: Column) -> Column:
        out = F.lit(False)
        for q in self.queries:
            out = out | F.contains(line, F.lit(q))
        if self.needs:
            out = out & line.rlike(self.needs)
        if self.never:
            out = out & ~line.rlike(self.never)
        if self.at:
            place = F.locate(self.at, line)
            out = out & ~((place > 0) & F.substring(line, place, F.length(line)).rlike(self.not_there))
        return out


#: Kinds of links, what gives them away, and what only looks like them.
KINDS = (
    Kind("events", ("@OnEvent(", ".emit(", "@Process(", "@Processor(", "@SubscribeMessage(", ".on("), never=r"\bprocess\.on\(", at=".on(", not_there=rf"^\.on\([{SPACE}]*['\"](?:[a-z.]+|connect_error|reconnect_\w+)['\"]"),
    Kind("stores", ("localStorage.", "sessionStorage.", "revalidateTag(", "cacheTag(", "queryKey", ".publish(", ".subscribe(", ".setex(", ".hset(", ".hget(", ".sadd(", ".expire("), needs=r"['\"`]|\b[A-Z][A-Z0-9_]{2,}\b"),
    Kind("switches", ("process.env.", "import.meta.env.", "configService.get", "config.get", "getOrThrow("), needs=r"\b(?:process|import\.meta)\.env\.|['\"`][A-Z][A-Z0-9_]+['\"`]"),
    Kind("entries", ("@Cron(", "@Interval(", "@Timeout(", "webhook", "Webhook"), needs=r"^@(?:Cron|Interval|Timeout|Post|Get|Put|Patch|Delete|All)\(|[Ww]ebhook\w*\s*\(", grouped=False),
)
#: Files of code, files of tests, comments, folders left out, decorators and the methods below them.
CODE_FILE = r"\.(m?[jt]sx?|cjs|vue)$"
TEST_FILE = r"\.(spec|test|stories)\.[jt]sx?$|(^|/)(test|tests|__tests__|__mocks__|e2e)/"
COMMENT = r"^(?://|/\*|\*)"
LEFT_OUT = ("node_modules", "dist", "build")
DECORATOR = r"^@(\w+)\("
METHOD = rf"^[{SPACE}]*(?:public[{SPACE}]+|private[{SPACE}]+|protected[{SPACE}]+)?(?:async[{SPACE}]+)?(?:\*[{SPACE}]*)?([A-Za-z_$][\w$]*)[{SPACE}]*[(<]"
AHEAD = 6


def is_code(path: Column, left_out: Sequence[str] = LEFT_OUT, code: str = CODE_FILE, tests: str = TEST_FILE) -> Column:
    """Whether a file may hold a side of a link."""
    out = path.rlike(code) & ~path.rlike(tests)
    for part in left_out:
        out = out & ~F.contains(path, F.lit(part))
    return out


@dataclass(frozen=True)
class Decoration:
    """What names a decorator, what its like begins with, and what names the thing below, at most ``ahead`` lines further."""

    name: str = DECORATOR
    like: str = rf"^[{SPACE}]*@"
    method: str = METHOD
    ahead: int = AHEAD

    def symbol(self, lines: Column, at: Column, code: Column) -> Column:
        """The first method in the lines after place ``at`` (from 0), else the decorator's own name; null if ``code`` is no decorator."""
        own = F.nullif(F.regexp_extract(code, self.name, 1), F.lit(""))
        later = F.transform(F.slice(lines, at + 2, self.ahead), lambda x: F.when(~x.rlike(self.like), F.nullif(F.regexp_extract(x, self.method, 1), F.lit(""))))
        return F.when(own.isNotNull(), F.coalesce(F.get(F.array_compact(later), F.lit(0)), own))


def linked_lines(files: DataFrame, path: str = "path", text: str = "text", kinds: Sequence[Kind] = KINDS, decoration: Decoration = Decoration()) -> DataFrame:
    """path, line (from 1), kind, code (the trimmed line), symbol and literal (empty for kinds that are not grouped) of each line of a kind."""
    free = [k.name for k in kinds if not k.grouped]

    def kept(lines):
        def one(x, i):
            code = F.regexp_replace(x, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")

            def row(own):
                names = F.array_compact(F.array(*(F.when(k.test(own), F.lit(k.name)) for k in kinds)))
                return F.when(~own.rlike(COMMENT) & (F.size(names) > 0), F.struct((i + 1).alias("line"), names.alias("kinds"), own.alias("code"), decoration.symbol(lines, i, own).alias("symbol")))

            return once(code, row)

        return F.array_compact(F.transform(lines, one))

    own = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.explode(once(F.split(F.col(text), "\n"), kept)).alias("l"))
    own = own.select("path", "l.line", F.explode("l.kinds").alias("kind"), "l.code", "l.symbol")
    return own.withColumn("literal", F.when(F.col("kind").isin(free), F.lit("")).otherwise(literal_of("code")))


def literal_sides(linked: DataFrame) -> DataFrame:
    """kind, literal, sides (lines of code that hold it) and first (path:line of the first), for lines with a literal."""
    place = F.struct("path", "line")
    own = linked.where("literal != ''").groupBy("kind", "literal").agg(F.count("*").alias("sides"), F.min(place).alias("p"))
    return own.select("kind", "literal", "sides", F.concat_ws(":", "p.path", "p.line").alias("first"))
