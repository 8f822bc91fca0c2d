"""What a prompt allows in its own words, as column expressions over whole texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import SPACE, col


@dataclass(frozen=True)
class Vocabulary:
    """``stems``: patterns of single words by category; ``phrases``: patterns of clauses; ``implies``: what follows from a category.

    A word is negated if one of ``before`` stands among the ``window`` words ahead of it, if one of ``after``
    follows it, or if ``particle`` follows it and then a word that ``verdict`` matches.
    """

    stems: dict[str, list[str]]
    phrases: dict[str, list[str]] = field(default_factory=dict)
    implies: dict[str, list[str]] = field(default_factory=dict)
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    particle: str = ""
    verdict: str = "(?!)"
    window: int = 3

    def closure(self) -> dict[str, list[str]]:
        """All that follows from each category, at any remove."""
        out = {}
        for category in self.implies:
            seen, open_ = set(), [category]
            while open_:
                for more in self.implies.get(open_.pop(), []):
                    if more not in seen:
                        seen.add(more)
                        open_.append(more)
            out[category] = sorted(seen)
        return out


#: Words and phrases by what they allow, what follows from what, and words that negate.
ACTIONS = Vocabulary(
    stems={
        "push": ["^(за)?пуш", "^push"],
        "mr": ["^(мр|mr|pr)$", "^мр(ка|ку|ки|ы)$", "^(с)?мер(д)?ж", "^merge$"],
        "push-force": ["^форс", "^force"],
        "delete": ["^удал(?!ен)", "^снес", "^сотри", "^стереть", "^(по)?чист[иь]", "^очист", "^вычист", "^delete", "^remove", "^rm$", "^clean", "^prune", "^wipe"],
        "revert": ["^откат", "^сбро[сш]", "^выкин", "^revert", "^reset", "^rollback", "^discard"],
        "deploy": ["^(за)?депло", "^выкат", "^раскат", "^(о)?публик", "^(за)?релиз", "^выложи", "^deploy", "^publish", "^release"],
        "migrate": ["^(с)?мигр", "^migrat", "^накат"],
    },
    phrases={
        "mr": [rf"(мерж|мердж|merge|пулл?|pull)[{SPACE}-]*(реквест|request)"],
        "push-force": [rf"пере(за)?пиши[{SPACE}]+историю", rf"rewrite[{SPACE}]+history"],
        "push-delete": [rf"(удал[^{SPACE}]*|снес[^{SPACE}]*|delete|remove)[{SPACE}]+([^{SPACE}]+[{SPACE}]+)?(ветк|branch)", rf"(все|всех|all)[{SPACE}]+([^{SPACE}]+[{SPACE}]+)?(ветк|branch)", "mirror|зеркал"],
    },
    implies={"mr": ["push"]},
    before=("не", "без", "нельзя", "никаких", "ничего", "don", "dont", "not", "no", "never", "without"),
    after=("нельзя", "not"),
    particle="не",
    verdict="^(надо|нужно|стоит|требуется|смей|вздумай)",
)
#: Words between clauses.
BETWEEN = "и|но|а|потом|затем|then|and|but"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def own_words(c: Column | str) -> Column:
    """The text without fenced blocks, pasted parts and quoted lines; null is the empty text."""
    plain = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)```.*?(?:```|\z)", "\n")
    plain = F.regexp_replace(plain, r"(?s)<pasted_content\b.*?(?:</pasted_content>|\z)", "\n")
    return F.array_join(F.filter(F.split(plain, "\n"), lambda line: ~line.rlike(rf"\A[{SPACE}]*>")), "\n")


def clauses(c: Column | str) -> Column:
    """The clauses of all sentences but questions, in lower case."""
    told = F.filter(F.split(own_words(c), r"(?<=[.!?\n])"), lambda s: ~s.rlike(rf"\?[{SPACE}]*\z"))
    plain = F.replace(F.lower(F.array_join(told, "\n")), F.lit("ё"), F.lit("е"))
    return F.split(plain, rf"[.,;:!?()\n]+|[{SPACE}](?:{BETWEEN})[{SPACE}]")


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def grants(c: Column | str, vocabulary: Vocabulary = ACTIONS) -> Column:
    """The categories that a prompt names without negation outside questions and quotes, sorted; empty for null or empty texts.

    The work is linear in the length of the text: every word looks at its nearest neighbours alone.
    """
    negative = lambda w: w.isin(*vocabulary.before)
    stem = {k: "|".join(f"(?:{p})" for p in v) for k, v in vocabulary.stems.items()}

    def by_word(words):
        def named(word, i):
            ahead = F.slice(words, F.greatest(i - vocabulary.window, F.lit(0)) + 1, F.least(i, F.lit(vocabulary.window)))
            a, b = (F.coalesce(F.get(words, i + k), F.lit("")) for k in (1, 2))
            negated = F.exists(ahead, negative) | a.isin(*vocabulary.after) | ((a == vocabulary.particle) & b.rlike(vocabulary.verdict))
            some = word.rlike("|".join(stem.values()))
            return F.when(some & ~negated, F.array_compact(F.array(*(F.when(word.rlike(p), F.lit(k)) for k, p in stem.items()))))

        return F.flatten(F.array_compact(F.transform(words, named)))

    def by_phrase(clause, pattern, category):
        """Its first place in the clause counts."""
        late = lambda words: F.exists(F.slice(F.reverse(words), 1, vocabulary.window), negative)
        ahead = F.get(F.split(clause, pattern, 2), F.lit(0))
        return F.when(clause.rlike(pattern) & ~once(words_of(ahead), late), F.lit(category))

    def found(clause):
        phrases = [by_phrase(clause, p, k) for k, v in vocabulary.phrases.items() for p in v]
        return F.concat(once(words_of(clause), by_word), F.array_compact(F.array(*phrases)) if phrases else F.array().cast("array<string>"))

    def closed(own):
        more = [F.when(F.array_contains(own, k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in vocabulary.closure().items() if v]
        return F.array_sort(F.array_distinct(F.concat(own, *more)))

    return once(F.flatten(F.transform(clauses(c), found)), closed)
