import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions.grants import Vocabulary, grants
from spanloom.operators import linkmine
from spanloom.sources import transcripts

GRANTS = {
    "сделай МР": "mr push", "открой PR на эту ветку": "mr push", "создай мерж-реквест": "mr push", "open a merge request": "mr push", "запушь ветку": "push", "commit and push": "push",
    "сделай форс пуш": "push push-force", "перезапиши историю на remote": "push-force", "удали ветку feat/x на remote": "delete push-delete", "удали dist": "delete", "сделай rm -rf node_modules": "delete",
    "откати изменения": "revert", "git reset --hard": "revert", "задеплой на прод": "deploy", "опубликуй пакет": "deploy", "накати миграцию": "migrate", "запушь в удалённый репозиторий": "push",
    "поправь опечатку в README": "", "": "", "не пушь пока": "", "закоммить без пуша": "", "пушить не надо": "", "don't push yet": "", "не удаляй ветку": "", "не трогай main, запушь feat": "push",
    "не трогай тесты и запушь": "push", "запушил?": "", "почему ты не запушил? проверь настройки": "", "тесты прошли? запушь": "push", "ты запушил": "push", "посмотри лог\n```\ngit push --force\nrm -rf .\n```": "",
    "что значит\n> задеплой и удали всё": "", "```\nlog\n```\nзапушь": "push", 'что тут\n<pasted_content id="a">\nзапушь и удали\n</pasted_content id="a">': "", "push not needed": "", "запушь, не забудь": "push",
    "not a b push": "", "not a b c push": "push", "```\nnever closed\nзапушь": "", "😀😀 не удаляй ветку": "", "слово " * 20_000 + "запушь": "push",
}


def test_grants(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*GRANTS, None])], "i int, text string")
    got = {r.i: " ".join(r.g) for r in rows.select("i", grants("text").alias("g")).collect()}
    assert got == dict(enumerate([*GRANTS.values(), ""]))


def test_what_follows(spark):
    chain = Vocabulary({"a": ["^a$"]}, implies={"a": ["b"], "b": ["c"], "c": ["a"]})
    assert spark.range(1).select(grants(F.lit("a"), chain).alias("g")).first().g == ["a", "b", "c"]


def user(content, **more):
    return {"type": "user", "message": {"content": content}, **more}


def test_last_prompts(spark):
    human = {"origin": {"kind": "human"}}
    push, said = user("запушь", **human), {"type": "assistant", "message": {"content": [{"type": "text", "text": "пушу"}]}}
    result = user([{"type": "tool_result", "tool_use_id": "t", "content": "ok"}])
    sessions = {
        "last": ([push, said, result], "запушь"),
        "next": ([push, said, user("спасибо, дальше тесты", **human)], "спасибо, дальше тесты"),
        "plan": ([user("4. Один push в конце", origin={"kind": "auto-continuation"})], ""),
        "menu": ([user("посмотри", **human), result], "посмотри"),
        "meta": ([user("посмотри", **human), user([{"type": "text", "text": "Push once"}], isMeta=True, **human)], "посмотри"),
        "blocks": ([user([{"type": "image"}, {"type": "text", "text": "сделай МР"}], **human)], "сделай МР"),
    }
    rows = [(s, p, json.dumps(r)) for s, (records, _) in sessions.items() for p, r in enumerate(records)] + [("broken", 0, "{bad"), ("broken", 1, None)]
    frame = spark.createDataFrame(rows, "session string, pos int, line string")
    assert {r.session: r.text for r in transcripts.last_prompts(frame).collect()} == {s: want for s, (_, want) in sessions.items()} | {"broken": ""}


@pytest.mark.parametrize("content,typed", [("go on", True), (" \n", False), ("[Request interrupted by user]", False), ("<command-name>x", False), ([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], True), ([{"type": "text", "text": "a"}, {"type": "image"}], False), ([], False), (None, False), (5, False)])
def test_typed(spark, content, typed):
    frame = spark.createDataFrame([("s", 0, json.dumps(user(content)))], "session string, pos int, line string")
    assert transcripts.prompts(frame).first().typed is typed


CODE = {
    "server/src/app.gateway.ts": """export class AppGateway {
  @SubscribeMessage('joinRoom')
  async handleJoinRoom(client: Socket) {
    this.server.emit(`${group}_newData`, data);
    // this.server.emit('legacyData', data);
  }
  @Cron(CronExpression.EVERY_HOUR)
  cleanup() {}
  onModuleInit() {
    process.on('SIGINT', () => {});
    this.logger.error('ошибка в handleWebhook');
  }
}""",
    "server/src/config.service.ts": """export function dbUrl(configService: ConfigService) {
  return configService.get<string>('DATABASE_URL') ?? process.env.DATABASE_URL;
}
export const LOG_DIR = process.env.APP_LOG_DIR || '/var/log';""",
    "client/src/hooks/useData.ts": """export function useData(socket: Socket, map: Map) {
  socket.on(`${group}_newData`, handle);
  map.on('style.load', init);
  socket.on('connect_error', retry);
  const raw = localStorage.getItem(DRAFT_KEY);
  stream.subscribe((res) => res);
  sessionStorage.setItem(INTRO_FLAG, '1');
  const list = JSON.parse(localStorage.getItem(LIST_KEY) || '[]');
}""",
    "client/src/hooks/useData.spec.ts": "socket.emit(`${group}_newData`, {});\n",
    "docs/notes.md": "`${group}_newData` by `.emit(`.\n",
}


def test_linked_lines(spark):
    files = spark.createDataFrame([*CODE.items(), ("empty.ts", ""), ("null.ts", None), (None, "x.emit('y1')")], "path string, text string")
    linked = linkmine.linked_lines(files.where(linkmine.is_code(F.col("path"))))
    got = {(r.path.rsplit("/", 1)[-1], r.line, r.kind, r.symbol, r.literal) for r in linked.collect()}
    assert got == {
        ("app.gateway.ts", 2, "events", "handleJoinRoom", "joinRoom"), ("app.gateway.ts", 4, "events", None, "${group}_newData"), ("app.gateway.ts", 7, "entries", "cleanup", ""),
        ("config.service.ts", 2, "switches", None, "DATABASE_URL"), ("config.service.ts", 4, "switches", None, "APP_LOG_DIR"), ("useData.ts", 2, "events", None, "${group}_newData"),
        ("useData.ts", 5, "stores", None, "DRAFT_KEY"), ("useData.ts", 7, "stores", None, "INTRO_FLAG"), ("useData.ts", 8, "stores", None, "LIST_KEY"),
    }
    sides = {r.literal: (r.sides, r.first) for r in linkmine.literal_sides(linked).collect()}
    assert sides["${group}_newData"] == (2, "client/src/hooks/useData.ts:2") and sides["joinRoom"] == (1, "server/src/app.gateway.ts:2") and len(sides) == 7


def test_symbols(spark):
    text = "@Cron(x)\n@Guard(y)\n  private async run<T>() {\n@Cron(x)\n\n\n\n\n\n\nlate() {}\n@Timeout(1)"
    linked = linkmine.linked_lines(spark.createDataFrame([("a.ts", text)], "path string, text string"))
    assert [(r.line, r.symbol) for r in linked.orderBy("line").collect()] == [(1, "run"), (4, "Cron"), (12, "Timeout")]
