"""Quotations planted in the given conversations, against a plain linker that compares texts."""

import random
from collections import defaultdict

import regex

from skyroute.llm.quotations import linked_conversations

SF = "/root/testdata/sf0.01"


def plain_key(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip()


def parts(text):
    return {text, *regex.split(r"\n[ \t]*\n", text), *text.split("\n")}


def planted(rows, seed=7):
    rng, out = random.Random(seed), []
    chats = defaultdict(list)
    for r in sorted(rows):
        chats[r[0]].append(r)
    for conv, said in chats.items():
        for i, (_, turn, role, text) in enumerate(said):
            kind = rng.randrange(4)
            line = lambda: rng.choice([x for x in (rng.choice(said[:i])[3] or "").split("\n") if plain_key(x)] or ["nothing"])  # noqa: E731, B023
            if i and kind == 0:
                text = f"> {line().upper()}\n{text}"
            elif i and kind == 1:
                text = f"Somebody wrote:\n>> {line()}\n> {line()}\n\n{text}"
            elif i > 1 and kind == 2:
                text = f">{line()}!\nMy words first.\n  > > {line()}\n>never said by anyone\n{text}"
            out.append((conv, turn, role, text))
    return out


def plain_links(rows):
    """(conv, turn) -> (text, quotes, linked, parent, branch) by reading each conversation from the top."""
    chats = defaultdict(list)
    for r in sorted(rows):
        chats[r[0]].append(r)
    out = {}
    for conv, said in chats.items():
        first, read = {}, []
        for _, turn, _, text in said:
            lines = []
            for x in (text or "").replace("\r\n", "\n").split("\n"):
                mark = regex.match(r"[ \t]*((?:>[ \t]*)+)", x)
                lines.append((mark[1].count(">"), x[mark.end() :]) if mark else (0, x))
            own, passages = [], []
            for k, (level, x) in enumerate(lines):
                intro = level == 0 and regex.search(r"(?i)\bwrote\s*:\s*$", x) and k + 1 < len(lines) and lines[k + 1][0] > 0
                if level == 0 and not intro:
                    own.append(x)
                if level:
                    if k and lines[k - 1][0] == level:
                        passages[-1][1].append(x)
                    else:
                        passages.append((level, [x]))
            own = regex.sub(r"^\n+|[ \t\n\x0b\f\r]+\Z", "", "\n".join(own)) if passages else text or ""
            read.append((turn, own, [(level, "\n".join(p)) for level, p in passages]))
            for p in parts(own):
                first.setdefault(plain_key(p), turn)
        first.pop("", None)
        before, branch = None, {}
        for turn, own, passages in read:
            hits = []
            for level, p in passages:
                known = [(len(x), first[plain_key(x)]) for x in parts(p) if first.get(plain_key(x), turn) < turn]
                if known:
                    hits.append((level, -max(known)[1]))
            quoted = -min(hits)[1] if hits else None
            parent = before if quoted is None else quoted
            way = branch.get(parent, [])
            branch[turn] = way + [turn] if quoted is not None and quoted != before else branch.get(before, [])
            out[conv, turn] = (own, len(passages), len(hits), parent, branch[turn])
            before = turn
    return out


def test_planted_quotations_against_plain_linker(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = planted([(r.conv_id, r.turn, r.role, r.text) for r in given.dropDuplicates(["conv_id", "turn"]).collect()])
    expected = plain_links(rows)
    found = linked_conversations(spark.createDataFrame(rows, given.schema)).collect()
    got = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.parent_turn, r.branch) for r in found}
    assert len(found) == len(got) == len(expected)
    assert sum(v[2] for v in expected.values()) > 100 and max(len(v[4]) for v in expected.values()) > 1
    wrong = {k: (got[k], v) for k, v in expected.items() if got[k] != v}
    assert not wrong, list(wrong.items())[:3]
    assert all(r.depth == len(r.branch) for r in found)
