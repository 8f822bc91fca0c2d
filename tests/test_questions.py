import pytest

from spanloom.functions.text import pending_question, prose_lines

ASKS = [
    ("Done.\n\nShall we go on? It takes an hour.", "Shall we go on? It takes an hour."),
    ("First?\nSecond?", "First?"),
    ("Merge it? 🚀", "Merge it? 🚀"),
    ("Question?\n```\ncode\n```\nDone.", None),
    ("Question?\n> quoted\nDone.", None),
    ("Is it?\n\n  ## Heading?", "Is it?"),
    ("Use `a?`", None),
    ("Which way?\n\n1. left\n2) right", "Which way?"),
    ("Which way?\n\n- left", None),
    ("Options\n\n- a\n* b\n• c", "Options"),
    ("Варианты: 1) один 2) два", "Варианты: 1) один 2) два"),
    ("На выбор:\n\nа) раз\nБ) два", "На выбор:"),
    ("Можно сейчас или потом", "Можно сейчас или потом"),
    ("Можно было сейчас или потом", None),
    ("Открытыми остаются три вопроса: a.\n\nDone.", "Открытыми остаются три вопроса: a."),
    ("Открытыми остаются ещё целых три вопроса: a.", None),
    ("Открыты два вопроса: a.\n\nDone.", "Открыты два вопроса: a."),
    ("Открыты два вопроса: a.\n\nDone.\n\nEnd.", None),
    ("Открытых вопросов нет.", None),
    ("Вопросы пока открыты.", "Вопросы пока открыты."),
    ("Open questions: one.\n\nEnd.", "Open questions: one."),
    ("Open questions: none.", None),
    ("He said «open questions» there.", None),
    ("Если появится запрос UAC — подтвердите его", None),
    ("The button says \"let me know\"", None),
    ("Жду вашего „ок“", "Жду вашего „ок“"),
    ("Plain report.", None),
    ("", None),
    (None, None),
] + [
    (f"Готово. {phrase}.", f"Готово. {phrase}.")
    for phrase in (
        "Как скажете", "Скажите", "напишите", "дайте знать", "подтвердите", "жду вашего", "жду вашей", "жду ваш", "жду ответа", "жду решения", "жду подтверждения", "жду отмашки", "жду команды", "жду ок",
        "если согласны", "если хотите", "если не против", "если скажете", "если нужно, тоже могу", "если надо, могу", "решать вам", "на ваше усмотрение", "выбор за вами",
        "let me know", "should I", "shall I", "want me to", "do you want", "would you like", "if you like", "if you'd prefer", "if you agree",
    )
]


def test_questions(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ASKS)], "i int, text string")
    got = {r.i: r.q for r in rows.select("i", pending_question("text").alias("q")).collect()}
    assert {ASKS[i][0]: q for i, q in got.items()} == dict(ASKS)


@pytest.mark.parametrize("text,want", [("a\n```\nx\n```\nb\n> q\nc", [(0, "a"), (2, "b"), (3, "c")]), ("a\r\n \t\r\n`x` b \n# H", [(0, "a"), (1, "b")])])
def test_paragraphs(spark, text, want):
    row = spark.createDataFrame([(text,)], "text string").select(prose_lines("text").alias("p")).first()
    assert [(x.paragraph, x.line) for x in row.p] == want
