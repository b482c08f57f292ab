"""The registered queries in SQL, where SQL can express them."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents
), item AS (
  SELECT item_id, ws, least(len(ws), 10) AS size
  FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i + 1 : i + size], ' ') AS win
  FROM (SELECT *, unnest(range(len(ws) - size + 1)) AS i FROM item)
), place AS (
  SELECT rid, size, i, array_to_string(ws[i + 1 : i + size], ' ') AS win
  FROM (SELECT rid, ws, size, unnest(range(len(ws) - size + 1)) AS i
        FROM doc, (SELECT DISTINCT size FROM win) WHERE len(ws) >= size)
), hit AS (
  SELECT rid, item_id, i, place.size AS size FROM place JOIN win USING (size, win)
), word AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
  FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (rid) LEFT JOIN items USING (rid)
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUALITY = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(ws[i + 1 : i + 8], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(len(ws) - 7)) AS i FROM doc WHERE len(ws) >= 8)
), twice AS (SELECT rid, win FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (rid, win)) GROUP BY rid
), m AS (
  SELECT rid, doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM doc LEFT JOIN rep USING (rid)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         ((n_words < 20)::BIGINT + (100 * n_repeat_words > 30 * n_words)::BIGINT
          + (100 * n_symbols > 10 * word_chars)::BIGINT + (100 * n_dup_lines > 30 * n_lines)::BIGINT
          + (100 * n_upper > 40 * word_chars)::BIGINT
          + (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT)::BIGINT AS n_failed
  FROM m
), host AS (
  SELECT source, count(*) AS n, count(*) FILTER (n_failed > 0) AS failed
  FROM f WHERE source IS NOT NULL GROUP BY source
), moment AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM host),
prior AS (
  SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN least(m * (1 - m) / v - 1, 1e6)
                 WHEN v > 0 THEN 1e-3 ELSE 1e6 END AS w FROM moment
), rate AS (
  SELECT source, (failed + m * w) / (n + m * w + (1 - m) * w) AS rate, n + w AS seen FROM host, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       n_failed = 0 AND coalesce(rate - 2 * sqrt(rate * (1 - rate) / (seen + 1)) <= 0.5, true) AS kept, n_failed, round(rate, 4) AS host_rate
FROM f LEFT JOIN rate USING (source)
"""

_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[ROLE |\[/ROLE\]"
CHAT = rf"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '{_CONTROL}')) AS controls,
         length(text) - length(replace(text, chr(92), '')) AS slashes,
         CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                   ELSE 14 + length(role) END + 3 AS frame
  FROM turn
), shown AS (
  SELECT *, frame + length(text) + CASE WHEN controls > 0 THEN 1 + controls + slashes ELSE 0 END AS chars
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """The checksum of an ASCII text, bit by bit."""
    bit = "list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {bit}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _sized(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sized(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, leaves: str) -> str:
    """The nodes (tree, level, idx, n, h) above ``leaves`` (tree, idx, n, h)."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, idx, n, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3, n
)"""


def _climb(name: str, start: str, levels: str) -> str:
    """Ways (rid, tree, level, idx, n, cur, sibs) up the nodes, from ``start``."""
    return f"""
{name} AS (
  SELECT rid, tree, 0 AS level, idx, n, cur, sibs FROM {start}
  UNION ALL
  SELECT p.rid, p.tree, p.level + 1, p.idx // 3, (p.n + 2) // 3,
         sha256(string_agg(CASE WHEN l.idx = p.idx THEN p.cur ELSE l.h END, '' ORDER BY l.idx)),
         p.sibs || coalesce(string_agg(l.h, '' ORDER BY l.idx) FILTER (l.idx <> p.idx), '')
  FROM {name} p JOIN {levels} l ON l.tree = p.tree AND l.level = p.level AND l.idx // 3 = p.idx // 3
  WHERE p.n > 1 GROUP BY p.rid, p.tree, p.level, p.idx, p.n, p.cur, p.sibs
)"""


MERKLE = f"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS key, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0
              THEN {_leaf("replace(text, chr(10), '')")} END AS changed
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY key) AS n, dense_rank() OVER (ORDER BY encode(key)) - 1 AS tree
  FROM doc
), leaves AS MATERIALIZED (
  SELECT rid, doc_id, tree, idx, n, leaf AS h, coalesce(changed, leaf) AS cur, '' AS sibs FROM ranked
),{_levels("low", "leaves")}, subroot AS MATERIALIZED (
  SELECT 0 AS tree, tree AS idx, (SELECT count(DISTINCT tree) FROM leaves) AS n, h FROM low WHERE n = 1
),{_levels("high", "subroot")}, root AS (SELECT h FROM high WHERE n = 1),
{_climb("way", "leaves", "low")}, halfway AS MATERIALIZED (
  SELECT rid, 0 AS tree, tree AS idx, (SELECT count(*) FROM subroot) AS n, cur, sibs FROM way WHERE n = 1
),{_climb("rest", "halfway", "high")}
SELECT doc_id, leaves.h AS leaf, subroot.h AS subroot, root.h AS root, sha256(rest.sibs) AS proof_sha256,
       rest.cur AS folded_root, rest.cur = root.h AS verified
FROM leaves JOIN rest USING (rid) JOIN subroot ON subroot.idx = leaves.tree, root WHERE rest.n = 1
"""

WARC = """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), kept AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM page
), shown AS (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM kept)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to, true AS intact
FROM shown
"""


def _repair_sql() -> str:
    """The cheapest repair by a table of four states a turn. A state holds its cost in
    eight digits and then its audit, so that the least text is the best path."""

    def add(state: str, cost: str, edit: str) -> str:
        return f"(lpad((left({state}, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || '{edit}')"

    def least(*paths: str) -> str:
        return f"least({', '.join(paths)})"

    extra = "CASE WHEN cut THEN 3 ELSE 0 END"
    may = lambda test, path: f"CASE WHEN NOT forced{test} THEN {path} END"
    rerole = lambda s: may("", add(s, f"3 + {extra}", "R"))
    keep = lambda s, role: may(f" AND initial = '{role}'", add(s, extra, "K"))
    drop = lambda s: add(s, "4", "D")
    # (from state, to state, role): 0 nothing yet, 1 system, 2 user, 3 assistant.
    moves = [(0, 1, "s"), (0, 2, "u"), (1, 2, "u"), (2, 3, "a"), (3, 2, "u")]
    turned = []
    for state in range(4):
        paths = [drop(f"p{state}")]
        for begin, end, role in moves:
            if end == state:
                paths.append(keep(f"p{begin}", role))
                if role != "s":
                    paths.append(rerole(f"p{begin}"))
        turned.append(least(*paths) + f" AS q{state}")
    one = [
        "q0 AS r0", "q1 AS r1",
        least("q2", *(add(f"q{s}", "3", "I") for s in (0, 1, 3))) + " AS r2",
        least("q3", add("q2", "3", "I")) + " AS r3",
    ]
    two = [
        "r0 AS p0", "r1 AS p1",
        least("r2", *(add(f"r{s}", "3", "I") for s in (0, 1, 3))) + " AS p2",
        least("r3", add("r2", "3", "I")) + " AS p3",
    ]
    white = r"[\x20\x09-\x0D]"
    legal = "('su', 'ua', 'au')"
    after = "CASE WHEN role IN ('', 's', 'a') THEN 'user' ELSE 'assistant' END"
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations
), harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS i FROM harmed
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_replace(text, '^{white}+|{white}+$', '', 'g') AS shown, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), row_ AS MATERIALIZED (
  SELECT conv_id, i, turn, role, text, initial, shown = '' OR again AS forced, shown = '' AS blank,
         shown <> '' AND again AS duplicate,
         shown <> '' AND NOT again AND NOT regexp_matches(shown, '[.!?]$') AS cut,
         before IS NOT NULL AND before || initial NOT IN {legal} AS illegal
  FROM judged
), conv AS MATERIALIZED (
  SELECT c.conv_id, count(i) AS rows, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
  GROUP BY c.conv_id
), step AS (
  SELECT conv_id, 0::BIGINT AS i, '00000000' AS p0, NULL::VARCHAR AS p1, '00000003I' AS p2, '00000006II' AS p3 FROM conv
  UNION ALL
  SELECT conv_id, i, {", ".join(two)} FROM (
    SELECT conv_id, i, {", ".join(one)} FROM (
      SELECT r.conv_id, r.i, {", ".join(turned)}
      FROM step JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.i = step.i + 1))
), best AS MATERIALIZED (
  SELECT conv.*, left(least(p0, p3), 8)::BIGINT AS cost, substr(least(p0, p3), 9) AS audit
  FROM conv JOIN step ON step.conv_id IS NOT DISTINCT FROM conv.conv_id AND step.i = conv.rows
), tale AS (
  SELECT conv_id, audit, 0 AS pos, 0::BIGINT AS i, '' AS role, [] ::VARCHAR[] AS lines FROM best
  UNION ALL
  SELECT conv_id, audit, pos, i, CASE WHEN edit = 'D' THEN role ELSE left(named, 1) END,
         CASE WHEN edit = 'D' THEN lines ELSE list_append(lines, named || ':' || text) END
  FROM (
    SELECT t.conv_id, audit, pos + 1 AS pos, t.i + (edit <> 'I')::BIGINT AS i, t.role, lines, edit,
           CASE WHEN edit = 'K' THEN r.role ELSE {after.replace("role", "t.role")} END AS named,
           CASE WHEN edit = 'I' THEN '' ELSE r.text END AS text
    FROM (SELECT *, substr(audit, pos + 1, 1) AS edit FROM tale WHERE pos < length(audit)) t
    LEFT JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1)
)
SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, cost, b.audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM best b JOIN tale t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.pos = length(b.audit)
"""


ORACLES: dict[str, str] = {
    "op11_turn_repair": _repair_sql(),
    "op12_merkle_manifest": MERKLE,
    "op13_warc": WARC,
    "op1_quality_rules": QUALITY,
    "op3_chat_format": CHAT,
    "op6_decontamination": DECONTAMINATION,
}
