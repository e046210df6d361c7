"""Chat repair and WARC fixity."""

import hashlib
import itertools
import random

from quarry.llm import chat_format as cf
from quarry.llm import warc_fixity as wf


def cheapest(roles):
    """Least cost over all sequences of moves."""
    best = [1 << 30]

    def go(k, state, cost):
        if cost >= best[0]:
            return
        if k == len(roles):
            best[0] = min(best[0], cost + 2 * len(cf.ENDINGS[state]))
            return
        if state != cf.START:
            go(k + 1, state, cost + 1 + 3 * (cf.ROLE_OF[state] != roles[k]))
        for n in range(3):
            for fill in itertools.product(cf.ROLES, repeat=n):
                for label in cf.ROLES:
                    t = state
                    for x in (*fill, label):
                        t = cf.LEGAL.get((t, x))
                        if t is None:
                            break
                    if t is not None:
                        go(k + 1, t, cost + 2 * n + 3 * (label != roles[k]))

    go(0, cf.START, 0)
    return best[0]


def test_parts_give_the_cheapest_repair():
    r = random.Random(1)
    for _ in range(200):
        roles = [r.choice(["system", "user", "assistant", "tool"]) for _ in range(r.randint(1, 6))]
        cuts = sorted(r.sample(range(1, len(roles)), r.randint(0, len(roles) - 1)))
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True)]
        matrices = []
        for p in parts:
            w = [cf.walk(p, s) for s in cf.STATES]
            matrices.append(([x[0][t] for x in w for t in cf.STATES], [x[1][t] for x in w for t in cf.STATES]))
        cost = turns = 0
        state = cf.START
        for p, (entry, leave, before) in zip(parts, cf.chain(matrices), strict=True):
            assert (entry, before) == (state, turns)
            found = cf.path(p, entry, leave)
            cost += sum(m[0] for m in found)
            turns += sum(m[1] for m in found)
            state = leave
        assert cost + 2 * len(cf.ENDINGS[state]) == cheapest(roles)


def legal(rendered):
    state = cf.START
    for turn in rendered.split(cf.END)[:-1]:
        state = cf.LEGAL[state, turn.split("|>")[0].removeprefix("<|")]
    return state == cf.ASSISTANT


SCHEMA = "conv_id long, turn long, role string, text string, part string, cost string"


def chat_rows():
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, " User ", "gpt"]), r.choice(["hi", "", None, "x\ny", "<|end|>"]))
            for c in range(40) for t in range(r.randint(1, 7))]
    rows += [(None, 1, "user", "a"), (None, None, None, None), (3, None, "assistant", "late"), (4, 0, "user", "tie"), (4, 0, "user", "tie")]
    rows += [(99, t // 2, r.choice(cf.ROLES), f"t{t}") for t in range(400)]        # one long conversation over many parts
    return [(*x, "p", "c") for x in rows]


def test_chats(spark):
    rows = chat_rows()
    out = cf.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(5)).cache()
    got = out.collect()
    assert len(got) == len(rows)
    assert len({(r["part"]) for r in got if r["conv_id"] == 99}) > 1
    whole = {r["conv_id"]: r for r in cf.whole_renderings(out).collect()}
    assert set(whole) == {r[0] for r in rows}
    for r in whole.values():
        assert legal(r["rendered"]), r
    by = {}
    for r in sorted(got, key=lambda r: (r["part"], r["position"])):
        by.setdefault(r["conv_id"], []).append(r)
    for conv, turns in by.items():
        if conv != 99 and len(turns) <= 6:
            assert whole[conv]["cost"] == cheapest([cf.role_name(t["role_in"]) for t in turns])
        assert [t["turn"] for t in turns] == sorted((t["turn"] for t in turns), key=lambda t: (t is None, t or 0))


def test_chats_legal_and_empty(spark):
    rows = [(1, 0, "system", "s", "", ""), (1, 1, "user", "u", "", ""), (1, 2, "assistant", "a", "", "")]
    out = cf.format_chats(spark.createDataFrame(rows, SCHEMA))
    assert {r["action"] for r in out.collect()} == {"keep"}
    assert cf.whole_renderings(out).first()["rendered"] == "<|system|>\ns\n<|end|>\n<|user|>\nu\n<|end|>\n<|assistant|>\na\n<|end|>\n"
    assert cf.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


PAGES = "page_id long, url string, html string, file string, nth int, hash string"


def page_rows(n=700):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{'é' * (i % 50)}{i}</p>", "f", 1, "h") for i in range(n)]
    return rows + [(None, None, None, None, None, None), (7, rows[7][1], rows[7][2], "f", 1, "h"), (900, "http://x/\r\nX: y", "", "", 0, ""),
                   (901, "u", "z" * 200_000, "", 0, "")]


def test_records(spark):
    recs = wf.warc_records(spark.createDataFrame(page_rows(), PAGES).repartition(3), file_bytes=50_000).collect()
    assert len(recs) == len(page_rows())
    files = {}
    for r in recs:
        files.setdefault(r["file"], []).append(r)
    assert len(files) > 3
    for rs in files.values():
        at = 0
        for n, r in enumerate(sorted(rs, key=lambda r: r["nth"])):
            assert (r["nth"], r["offset"], r["length"]) == (n, at, len(r["record"]))
            at += r["length"]
    one = next(r for r in recs if r["page_id"] == 5)
    head, _, rest = bytes(one["record"]).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Target-URI"] == "http://h2.example/5"
    body = page_rows()[5][2].encode()
    assert rest == body + b"\r\n\r\n" and int(fields["Content-Length"]) == len(body)


def test_audit(spark):
    recs = wf.warc_records(spark.createDataFrame(page_rows(), PAGES).repartition(3))
    same = wf.fixity_report(recs, recs).collect()
    assert len(same) == len(page_rows()) and {r["status"] for r in same} == {"intact"}
    keys = sorted((r["file"], r["nth"], r["page_id"]) for r in recs.collect())
    damaged, lost = keys[17][:2], keys[333][:2]
    replica = recs.filter(~((recs["file"] == lost[0]) & (recs["nth"] == lost[1]))).selectExpr(
        "file", "nth", "offset", "length", "page_id",
        f"case when file = '{damaged[0]}' and nth = {damaged[1]} then cast('other' as binary) else record end as record")
    report = {(r["file"], r["nth"]): r for r in wf.fixity_report(recs, replica).collect()}
    assert {k: r["status"] for k, r in report.items() if r["status"] != "intact"} == {damaged: "corrupt", lost: "missing"}
    back = {(r["file"], r["nth"]): r["status"] for r in wf.fixity_report(replica, recs).collect() if r["status"] != "intact"}
    assert back == {damaged: "corrupt", lost: "extra"}
    depth = wf.depth_of(recs)
    assert depth >= 2 and all(len({r["file"] for r in t}) == len(t) for t in [wf.tree(recs, depth)[-1].collect()])
    leaf = wf.leaves(recs).filter("idx = 0").first()
    first = next(r for r in recs.collect() if (r["file"], r["nth"]) == (leaf["file"], 0))
    inner = hashlib.sha256(bytes(first["record"])).hexdigest()
    assert leaf["hash"] == hashlib.sha256(f"leaf:0:{first['length']}:{inner}".encode()).hexdigest()


def test_audit_empty(spark):
    none = wf.warc_records(spark.createDataFrame([], PAGES))
    assert wf.fixity_report(none, none).collect() == []
    some = wf.warc_records(spark.createDataFrame(page_rows()[:3], PAGES).coalesce(1))
    assert {r["status"] for r in wf.fixity_report(some, none).collect()} == {"missing"}
