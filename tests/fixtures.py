"""A small corpus in the three wire formats, written to a folder. All names and words are invented."""

import json
from pathlib import Path

USERS = [
    {"id": "U1", "name": "mira", "real_name": "Mira Solano", "profile": {"display_name": "mira", "email": "mira@orchard.test", "title": "Editor"}},
    {"id": "U2", "name": "alexb", "real_name": "Alex Brandt", "profile": {"display_name": "", "email": "alex.brandt@orchard.test", "title": "Producer"}},
    {"id": "U3", "name": "alexr", "real_name": "Alex Rowe", "profile": {"email": "alex.rowe@orchard.test"}},
    {"id": "U4", "name": "tom"},
]


def thread(channel: str, visibility: str, ts: str, messages: list[tuple[str, str, str]]) -> dict:
    return {
        "channel": {"id": channel, "name": channel.lower(), "visibility": visibility, "topic": "unused"},
        "thread_ts": ts,
        "messages": [{"type": "message", "ts": t, "thread_ts": ts, "user": u, "text": x, "permalink": f"https://chat.test/{t}"} for t, u, x in messages],
    }


THREADS = {
    "launch": thread("C1", "PUBLIC", "1770800000.000100", [
        ("1770800100.000200", "U2", "Agreed, thanks."),
        ("1770800000.000100", "U1", "Decision: the podcast launches on May 4."),
        ("1770800200.000000", "U9", "Risk: the studio may be double booked."),
    ]),
    "moved": thread("C1", "PUBLIC", "1775000000.000000", [("1775000000.000000", "U1", "Decision: the podcast launches on May 18.")]),
    "again": thread("C2", "RESTRICTED", "1778000000.000000", [("1778000000.000000", "U2", "Decision: the podcast launches on June 1.")]),
    "empty": {"channel": {"id": "C3", "name": "quiet"}, "thread_ts": "1.0", "messages": []},
}

VTT = """WEBVTT

1
00:00:01.000 --> 00:00:03.500
Mira Solano: We start with the budget.

2
00:00:04.000 --> 00:00:06.000
Mira Solano: Decision: the budget stays
at forty thousand.

3
01:02.250 --> 01:04.000
Speaker 2: Fine by me, as long as this holds: no travel.

4
00:01:10,000 --> 00:01:11,000
a remark without any name that is long enough to put this colon: far away

5
no timing here
"""

META = {"uuid": "m-77", "topic": "Budget sync", "start_time": "2026-03-02T10:00:00Z", "scope": {"id": "ops", "visibility": "PRIVATE"}, "participants": [{"name": "Mira Solano", "email": "MIRA@orchard.test"}, {"name": "Noor Haddad", "email": "noor@partner.test"}, {"name": "Alex Rowe", "email": None}]}

PAGE = """---
id: page-9
title: "Studio plan: draft"
created_by: "Mira Solano"
last_edited_by: "Jun Park"
last_edited_time: 2026-04-01T08:00:00Z
visibility: PUBLIC
url: https://wiki.test/page-9
---

# Studio plan

## Decision

Commitment: Jun delivers the acoustic panels
by April 20.

Plain words.

## Left over
"""


def write_corpus(root: Path) -> str:
    for folder in ("slack/threads", "zoom", "notion"):
        (root / folder).mkdir(parents=True)
    (root / "slack/users.json").write_text(json.dumps(USERS))
    for name, t in THREADS.items():
        (root / f"slack/threads/{name}.json").write_text(json.dumps(t))
    (root / "zoom/budget.vtt").write_text(VTT)
    (root / "zoom/budget.meta.json").write_text(json.dumps(META))
    (root / "zoom/orphan.vtt").write_text("WEBVTT\n\n00:05.000 --> 00:06.000\nAnn: Alone.\n")
    (root / "notion/plan.md").write_text(PAGE)
    (root / "notion/bare.md").write_text("Just text.\n\n\nMore text.")
    return str(root)
