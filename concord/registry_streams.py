"""Queries of upkeep and sessions: owners after a change, versions held, decisions of sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import ownership
from concord.registry import FILES, GLOB_SQL, GLOBS, query
from concord.sources import tables as T
from concord.streaming import changes, sessions

#: Files after a change: a fifth came, and of those before a seventh went.
AFTER = FILES.replace(" FROM pages)", " FROM pages WHERE {0} % 5 = 0 OR {0} % 7 <> 0)".format("length(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''))"))


def _change(spark, sf):
    """Globs, files before, files that come and files that go."""
    files = T.page_files(spark, sf)
    before = files.where("length(path) % 5 <> 0")
    return ownership.glob_table(spark, GLOBS), before, files.where("length(path) % 5 = 0"), before.where("length(path) % 7 = 0")


@query(f"WITH {AFTER}, {GLOB_SQL} SELECT path, state, CASE WHEN state = 'owned' THEN owners END AS owner, owners FROM o")
def owners_after_change(spark, sf):
    globs, before, added, removed = _change(spark, sf)
    return ownership.changed_owners(ownership.owners(before, globs), added, removed, globs)


@query(f"WITH {AFTER}, {GLOB_SQL}, ids AS (SELECT unnest(range(10))::INT AS glob_id) SELECT ids.glob_id, count(path) AS hits FROM ids LEFT JOIN (SELECT * FROM k WHERE counts) x ON ids.glob_id = x.glob_id GROUP BY ids.glob_id")
def glob_hits_after_change(spark, sf):
    globs, before, added, removed = _change(spark, sf)
    return ownership.changed_hits(ownership.glob_hits(before, globs), added, removed, globs).select("glob_id", "hits")


@query("WITH e AS (SELECT user_id, event_id, event_type, event_id % 3 = 0 AS valid FROM events), g AS (SELECT user_id, max(event_id) AS event_id FROM e WHERE valid GROUP BY user_id) SELECT g.user_id, g.event_id, e.event_type, g.event_id < (SELECT max(event_id) FROM e x WHERE x.user_id = g.user_id) AS held FROM g JOIN e ON e.event_id = g.event_id")
def last_good_versions(spark, sf):
    e = T.table(spark, sf, "events").select("user_id", "event_id", "event_type", F.expr("event_id % 3 = 0").alias("valid"))
    return changes.last_good(e, "user_id", "event_id")


#: An event of the table as an event of a session.
SESSION_EVENT = [
    "CASE event_id % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS agent", "event_id AS seq",
    "CASE WHEN event_id % 11 < 4 THEN 'pre-tool' WHEN event_id % 11 < 6 THEN 'pre-edit' WHEN event_id % 11 = 8 THEN 'subagent-stop' WHEN event_id % 11 = 9 THEN 'post-compact' ELSE 'stop' END AS phase",
    "(event_id * 5 + user_id) % 8 AS f", "event_id % 5 AS i", "event_id % 4 AS a", "event_id % 3 = 0 AS applied", "event_id % 2 = 0 AS changes", "event_id % 7 < 2 AS config_changed", "event_id % 13 = 0 AS stop_active",
]
LISTS = {
    "found": "CASE f WHEN 0 THEN {0} WHEN 1 THEN {1}'p'{2} WHEN 2 THEN {1}'q'{2} WHEN 3 THEN {1}'p', 'q'{2} WHEN 4 THEN {1}'r'{2} WHEN 5 THEN {1}'p', 'r'{2} WHEN 6 THEN {1}'p', 'q', 'r'{2} ELSE {1}'p', 'q'{2} END",
    "invalid": "CASE i WHEN 0 THEN {1}'c'{2} WHEN 1 THEN {1}'c', 'd'{2} ELSE {0} END",
    "invalid_before": "CASE WHEN seq % 10 < 2 THEN {1}'c'{2} ELSE {0} END",
    "advice": "CASE a WHEN 0 THEN {1}'v'{2} WHEN 1 THEN {1}'v', 'w'{2} ELSE {0} END",
}


def _lists(none: str, left: str, right: str) -> list[str]:
    return [f"{x.format(none, left, right)} AS {name}" for name, x in LISTS.items()]


def _minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def _both(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: list_contains({b}, x))"


_DENIED = f"phase = 'pre-edit' AND len(invalid) > 0 AND NOT applied AND (len({_minus('invalid', 'invalid_before')}) > 0 OR len(invalid) > len(invalid_before))"


@query(f"""WITH RECURSIVE x AS (SELECT CAST(user_id AS VARCHAR) AS session, {", ".join(SESSION_EVENT)} FROM events), e AS (SELECT *, {", ".join(_lists("CAST([] AS VARCHAR[])", "[", "]"))} FROM x),
m AS (SELECT session, coalesce(agent, '') AS agent, seq, phase, found, invalid, invalid_before, advice, applied, changes, config_changed, stop_active FROM e
UNION ALL SELECT session, '', seq, 'dirty', [], [], [], [], false, false, false, false FROM e WHERE agent IS NOT NULL AND ((phase = 'pre-tool' AND changes) OR (phase = 'pre-edit' AND NOT ({_DENIED})))),
ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session, agent ORDER BY seq, phase <> 'dirty') AS k FROM m),
r AS (SELECT session, agent, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS kind, 0::BIGINT AS fresh, 0::BIGINT AS old, 0::BIGINT AS resolved, false AS repeated, 0::BIGINT AS advised, CAST([] AS VARCHAR[]) AS shown, CAST([] AS VARCHAR[]) AS pending, CAST([] AS VARCHAR[]) AS last, CAST(NULL AS VARCHAR[]) AS base, CAST([] AS VARCHAR[]) AS told, false AS dirty, false AS blocked FROM ev WHERE k = 1
UNION ALL SELECT session, agent, k, seq,
CASE WHEN phase = 'dirty' THEN 'mark' WHEN phase = 'post-compact' OR idle OR quiet THEN 'silent' WHEN denied THEN 'deny' WHEN ended THEN CASE WHEN len(found) = 0 THEN CASE WHEN news > 0 THEN 'note' ELSE 'silent' END WHEN again THEN 'silent' ELSE 'block' END WHEN n1 + n2 + n3 + len(adv) > 0 THEN 'context' ELSE 'silent' END,
CASE WHEN denied THEN len(invalid) WHEN counted THEN n1 ELSE 0 END, CASE WHEN counted THEN n2 ELSE 0 END, CASE WHEN counted THEN n3 ELSE 0 END, blocks AND len({_minus("found", "last")}) = 0,
CASE WHEN looks AND NOT quiet THEN len(adv) WHEN blocks OR (ended AND NOT idle AND len(found) = 0) THEN news ELSE 0 END,
CASE WHEN phase = 'post-compact' THEN [] WHEN (ended AND NOT idle) OR (looks AND NOT quiet) THEN list ELSE shown END, CASE WHEN (ended AND NOT idle) OR (looks AND NOT quiet) THEN list ELSE pending END,
CASE WHEN ended AND NOT idle AND len(found) = 0 THEN [] WHEN blocks THEN found ELSE last END, CASE WHEN ended AND NOT idle AND base1 IS NOT NULL THEN advice ELSE base1 END, CASE WHEN ended AND NOT idle THEN [] ELSE list_concat(told, adv) END,
CASE WHEN phase = 'dirty' OR edits OR (phase = 'pre-tool' AND changes) THEN true WHEN ended AND NOT idle THEN false ELSE dirty END,
CASE WHEN phase = 'dirty' OR edits OR (phase = 'pre-tool' AND changes) THEN false WHEN ended AND NOT idle THEN len(found) > 0 AND (blocks OR blocked OR stop_active) ELSE blocked END
FROM (SELECT *, (looks AND NOT quiet) OR blocks AS counted FROM (SELECT *, ended AND NOT idle AND len(found) > 0 AND NOT again AS blocks, len({_minus("list", "shown")}) AS n1, len({_both("list", "shown")}) AS n2, len({_minus("pending", "list")}) AS n3
FROM (SELECT *, phase = 'pre-tool' AND len(pending) = 0 AND NOT config_changed AND len(adv) = 0 AS quiet, stop_active OR (blocked AND pending = found) AS again, CASE WHEN base1 IS NULL THEN 0 ELSE len({_minus("advice", "base1")}) END AS news,
CASE WHEN edits AND len(invalid) > 0 AND applied THEN invalid WHEN phase = 'pre-tool' AND NOT config_changed THEN {_both("found", "pending")} ELSE found END AS list
FROM (SELECT *, CASE WHEN looks AND config_changed THEN {_minus(_minus("advice", "base1"), "told")} ELSE [] END AS adv
FROM (SELECT *, CASE WHEN looks AND base IS NULL THEN advice ELSE base END AS base1
FROM (SELECT *, phase = 'pre-edit' AND NOT denied AS edits, phase = 'pre-tool' OR (phase = 'pre-edit' AND NOT denied) AS looks, ended AND NOT dirty AND len(pending) = 0 AS idle
FROM (SELECT ev.*, shown, pending, last, base, told, dirty, blocked, {_DENIED} AS denied, phase IN ('stop', 'subagent-stop') AS ended FROM r JOIN ev ON ev.session = r.session AND ev.agent = r.agent AND ev.k = r.k + 1)))))))
)
SELECT session, agent, seq, kind, fresh, old, resolved, repeated, advised FROM r WHERE k > 0 AND kind <> 'mark'""")
def session_decisions(spark, sf):
    e = T.table(spark, sf, "events").selectExpr("cast(user_id as string) AS session", *SESSION_EVENT)
    return sessions.decisions(e.selectExpr("*", *_lists("cast(array() as array<string>)", "array(", ")")))
