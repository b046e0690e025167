"""Transcripts: what no SQL says, against plain Python over the same files."""

import json
import re

from spindrift.plans import transcript_queries as tq

ROWS = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} of turn {t} \"quoted\" é\nsecond line " + "long " * (c % 30)) for c in range(40) for t in range(4)] + [(None, 0, "user", "x"), (41, 0, "user", None)]


def files(spark):
    return tq.files_of(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))


def preview(text, most):
    text = " ".join(text.split())
    if len(text) <= most:
        return text
    head = text[: most - 1]
    return (head.rsplit(" ", 1)[0] if " " in head else head) + "…"


def test_titles_equal_a_plain_reading(spark):
    df = files(spark).cache()
    want = {}
    for r in df.collect():
        seen, titles, asked, cwd, times, kinds = set(), {}, [], None, [], {"human": 0, "command": 0, "interrupt": 0}
        for line in re.split(r"\r?\n", r.content):
            try:
                x = json.loads(line) if line.startswith("{") else None
            except ValueError:
                x = None
            if not x or x.get("uuid") in seen:
                continue
            seen |= {x["uuid"]} if "uuid" in x else set()
            titles[x.get("type")] = x.get("title") or titles.get(x.get("type"))
            cwd = cwd or x.get("cwd")
            if "timestamp" in x:
                times.append(x["timestamp"] * 1000 if x["timestamp"] <= 1e12 else x["timestamp"])
            content = x.get("message", {}).get("content")
            if x.get("type") == "user" and isinstance(content, str):
                kind = "command" if content.startswith("<command-name>") else "interrupt" if content.startswith("[Request interrupted") else "human"
                kinds[kind] += 1
                shown = " ".join(re.findall(r">([^<]+)</command-(?:name|args)>", content)) if kind == "command" else preview(content, 60)
                asked.append((kind, shown))
        title = titles.get("custom-title") or titles.get("ai-title") or next((s for k, s in asked if k == "human"), None) or next((s for k, s in asked if k == "command"), "")
        want[r.session] = (title, cwd, min(times), kinds["human"], kinds["command"], kinds["interrupt"])
    got = {r.session: (r.title, r.cwd, r.start_ms, r.human_prompts, r.command_prompts, r.interrupt_prompts) for r in tq.titles(df).collect()}
    assert got == want
    assert {t for t, *_ in want.values()} >= {"Title 0", "/review all"} or any(t.startswith("Title") for t, *_ in want.values())


def test_scan_sees_bad_lines_cut_tails_and_blank_lines(spark):
    df = spark.createDataFrame([("a", "p", '{"type":"user"}\r\n\r\n {"x":1}\n[1]\n{"type":'), ("b", "p", '{"type":"user"}\n'), ("c", "p", '{"type":"user"}'), ("d", "p", "")], "session string, slug string, content string")
    got = {r.session: (r.lines, r.records, r.bad, r.first_bad, r.possibly_live, r.rejected) for r in tq.scan_report(df).collect()}
    assert got == {"a": (4, 1, 3, 3, True, "no"), "b": (1, 1, 0, None, False, "no"), "c": (1, 1, 0, None, False, "no")}
