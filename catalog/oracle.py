"""DuckDB SQL for the registered queries, written from the specification.

The derived tables of FIXTURES.md are common table expressions, put in front of
a query with everything they need.
"""

from __future__ import annotations

import re

from catalog.queries import BY_TOKENS, LEAST_SHARE, SCANS
from chatterloom.config import NON_TEXT, CompactionConfig, Wording

CHECKED_FOLDER = "/root/testdata/sf0.01"
PAGE_BYTES, PAGED = 8 * 1024 * 1024, 256
W = Wording()
DEFAULTS = CompactionConfig()
SMALL = CompactionConfig(max_tokens=100, max_messages=4, keep_last=2)
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(expr: str) -> str:
    return STRIP.format(expr)


def text(value: str) -> str:
    """A string as a SQL literal, line breaks included."""
    return "E'" + value.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


CTES: dict[str, str] = {
    "base": r"""
        SELECT conv_id, turn, conv_id::VARCHAR || '-' || turn::VARCHAR AS message_id,
          CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'system' END AS type,
          CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN ''
               WHEN role = 'user' AND turn % 5 = 4 THEN NULL
               WHEN role = 'user' AND turn % 5 = 3
                 THEN text || E'\n\n[Attached image - vision analysis: img-' || conv_id::VARCHAR || ']'
               ELSE text END AS content,
          CASE WHEN role = 'user' AND turn % 5 = 4
               THEN CASE WHEN conv_id % 2 = 0 THEN text ELSE '[image]' END END AS block_text,
          CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN conv_id % 3 + 1 ELSE 0 END AS n_calls,
          TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE AS ts
        FROM conversations""",
    "m": """
        SELECT conv_id::VARCHAR AS thread_id, turn AS position, *, coalesce(content, block_text) AS shown
        FROM base""",
    "lm": """
        SELECT (conv_id % 10)::VARCHAR AS thread_id,
          row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) - 1 AS position,
          *, coalesce(content, block_text) AS shown
        FROM base""",
    "ev": """
        SELECT thread_id, conv_id, position * 10 + step AS seq,
          CASE WHEN step = 5 THEN 'remove' ELSE 'append' END AS op, message_id,
          CASE WHEN step <> 5 THEN type END AS type,
          CASE WHEN step <> 5 THEN content END AS content, ts + step * INTERVAL 1 SECOND AS ts
        FROM m, (VALUES (0), (5), (7)) s(step)
        WHERE step = 0 OR (position % 7 = 5 AND (step = 5 OR conv_id % 2 = 0))""",
    "sess": f"""
        SELECT thread_id, title, created_at, created_at + n * INTERVAL 1 MINUTE AS updated_at,
          n::INTEGER AS message_count, 'user_' || (thread_id::BIGINT % 7)::VARCHAR AS username
        FROM (SELECT thread_id, count(*) AS n,
                coalesce(nullif(substring({strip("arg_min(shown, position) FILTER (type = 'human')")}, 1, 40), ''),
                         'New Chat') AS title,
                TIMESTAMP '2024-01-01' + thread_id::BIGINT * INTERVAL 1 HOUR AS created_at
              FROM m GROUP BY thread_id)""",
    "summ": """
        SELECT thread_id, CASE WHEN thread_id::BIGINT % 3 = 0 THEN 'summary ' || thread_id ELSE '' END AS summary,
          (CASE WHEN thread_id::BIGINT % 3 = 0 THEN n // 2 ELSE 0 END)::INTEGER AS summarized_count,
          TIMESTAMP '2024-01-01' + thread_id::BIGINT * INTERVAL 1 HOUR + n * INTERVAL 1 MINUTE AS updated_at
        FROM (SELECT thread_id, count(*) AS n FROM m GROUP BY thread_id)
        WHERE thread_id::BIGINT % 3 = 0 OR (thread_id::BIGINT % 3 = 1 AND thread_id::BIGINT > 0)""",
    "lsumm": """
        SELECT thread_id, CASE WHEN thread_id::BIGINT % 3 = 0 THEN 'summary ' || thread_id ELSE '' END AS summary,
          (CASE WHEN thread_id::BIGINT % 3 = 0 THEN n // 2 ELSE 0 END)::INTEGER AS summarized_count
        FROM (SELECT thread_id, count(*) AS n FROM lm GROUP BY thread_id)
        WHERE thread_id::BIGINT % 3 = 0 OR (thread_id::BIGINT % 3 = 1 AND thread_id::BIGINT > 0)""",
    "ck": """
        SELECT user_id::VARCHAR AS thread_id, lpad(event_id::VARCHAR, 12, '0') AS checkpoint_id,
          lag(lpad(event_id::VARCHAR, 12, '0')) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_checkpoint_id, ts
        FROM events""",
    "usess": """
        SELECT user_id::VARCHAR AS thread_id, 'thread ' || user_id::VARCHAR AS title, min(ts) AS created_at,
          max(ts) AS updated_at, count(*)::INTEGER AS message_count, 'user_' || (user_id % 7)::VARCHAR AS username
        FROM events WHERE user_id % 5 <> 0 GROUP BY user_id""",
    "sev": """
        SELECT user_id::VARCHAR AS thread_id,
          CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'rename'
                          WHEN 'view' THEN 'touch' ELSE 'delete' END AS op,
          CASE WHEN event_type = 'click' THEN 't-' || event_id::VARCHAR END AS title,
          CASE WHEN event_type = 'view' THEN floor(value)::INTEGER END AS message_count, ts, event_id AS seq
        FROM events WHERE event_type <> 'purchase'""",
    "acct": """
        SELECT lower(trim(c_name)) AS username, TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 1 MINUTE AS created_at
        FROM customer""",
    "src": """
        SELECT DISTINCT source, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS number FROM documents""",
    "prof": """
        SELECT profile_id, name, TIMESTAMP '2024-01-01' + number * INTERVAL 1 HOUR AS created_at,
          TIMESTAMP '2024-01-01' + number * INTERVAL 1 HOUR + (number % 5) * INTERVAL 1 DAY AS updated_at,
          'user_' || (number % 7)::VARCHAR AS username
        FROM (SELECT source AS profile_id, 'Profile ' || source AS name, number FROM src
              UNION ALL SELECT DISTINCT 'empty' || (number % 7)::VARCHAR, 'Empty', number % 7 FROM src)""",
    "note": """
        SELECT source AS profile_id, lpad(doc_id::VARCHAR, 12, '0') AS note_id, text,
          strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at,
          (doc_id % 10)::VARCHAR AS source_thread_id, doc_id
        FROM documents""",
    "lnote": "SELECT * FROM note WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "preq": """
        SELECT source AS profile_id, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS ts,
          'user_' || ((regexp_extract(source, '(\\d+)$', 1)::BIGINT + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) % 7)::VARCHAR AS username
        FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""",
    "pdec": """
        SELECT f.profile_id, f.username, f.ts,
          CASE WHEN p.profile_id IS NULL THEN 'ignored'
               WHEN row_number() OVER (PARTITION BY f.username, p.profile_id IS NULL ORDER BY f.ts, f.profile_id) <= h.held - 1
               THEN 'deleted' ELSE 'rejected' END AS outcome
        FROM (SELECT profile_id, username, min(ts) AS ts FROM preq GROUP BY ALL) f
        LEFT JOIN prof p ON p.profile_id = f.profile_id AND p.username = f.username
        LEFT JOIN (SELECT username, count(*) AS held FROM prof GROUP BY username) h ON h.username = f.username""",
    "tprof": """
        SELECT DISTINCT thread_id, 'src' || (thread_id::BIGINT % 20)::VARCHAR AS profile_id FROM m""",
    "calls": f"""
        SELECT thread_id, profile_id, message_id, position, ts, call_no, message_id || '-c' || call_no::VARCHAR AS tool_call_id,
          ['add_memory', 'forget_memory', 'search_web'][call_no + 1] AS tool,
          ['put', 'delete', 'unknown'][call_no + 1] AS action,
          CASE call_no WHEN 0 THEN sha256(thread_id || ':' || message_id || '-c0')
                       WHEN 1 THEN lpad(conv_id::VARCHAR, 12, '0') END AS note_id
        FROM m JOIN tprof USING (thread_id), (VALUES (0::BIGINT), (1), (2)) c(call_no) WHERE call_no < n_calls""",
    "effects": f"""
        SELECT *, CASE action WHEN 'put' THEN {text(W.note_saved)} || note_id
                  WHEN 'delete' THEN {text(W.note_removed)} || note_id ELSE 'Unknown tool: ' || tool END AS answer
        FROM calls""",
    "tev": """
        SELECT thread_id, seq * 100 AS seq, op, message_id, type, content FROM ev
        UNION ALL
        SELECT thread_id, position * 1000 + 1 + call_no, 'append', tool_call_id || '-result', 'tool', answer FROM effects""",
    "dense": """
        SELECT thread_id, position * 100 AS seq, 'append' AS op, message_id, type, content FROM m
        UNION ALL
        SELECT thread_id, position * 100 + 1 + k, 'append', message_id || '-c' || k::VARCHAR || '-result', 'tool',
          'Unknown tool: search_web' FROM m, range(12) r(k) WHERE n_calls > 0""",
    "ext": r"""
        SELECT lpad(doc_id::VARCHAR, 12, '0') AS response_id, (doc_id % 10)::VARCHAR AS thread_id, source AS profile_id,
          CASE WHEN doc_id % 13 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN ' NONE '
               ELSE '- ' || replace(text, '. ', E'.\n- ') END AS text
        FROM documents""",
    "usable": f"""
        SELECT response_id, thread_id, profile_id, {strip('text')} AS body FROM ext
        WHERE {strip('text')} NOT IN ('', 'NONE')
          AND thread_id IN (SELECT thread_id FROM (
            SELECT thread_id, arg_max(shown, position) AS t FROM lm WHERE type = 'human' GROUP BY thread_id) WHERE t <> '')""",
    "edit": """
        SELECT thread_id, max(seq) AS top FROM ev GROUP BY thread_id""",
}


def folded(events: str, keys: str = "thread_id") -> str:
    """Fold of a message log: last removal, then first and last append after it."""
    return f"""
        SELECT * FROM (
          SELECT a.*, row_number() OVER (PARTITION BY {keys} ORDER BY first_seq) - 1 AS position FROM (
            SELECT {keys}, message_id, min(seq) AS first_seq, max(seq) AS last_seq,
              arg_max(type, seq) AS type, arg_max({{'c': content}}, seq).c AS content
            FROM (SELECT *, max(CASE WHEN op = 'remove' THEN seq END)
                         OVER (PARTITION BY {keys}, message_id) AS gone FROM {events})
            WHERE op = 'append' AND (gone IS NULL OR seq > gone)
            GROUP BY {keys}, message_id) a)"""


def _needs(sql: str, seen: list[str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s+{name}\b(?=\s*[,)\n]|\s+\w)", sql):
            _needs(CTES[name], seen)
            if name not in seen:
                seen.append(name)


def q(sql: str, recursive: bool = False, **extra: str) -> str:
    """``sql`` with the derived tables it uses in front."""
    seen: list[str] = []
    for body in [*extra.values(), sql]:
        _needs(body, seen)
    parts = [f"{n} AS ({CTES[n]})" for n in seen] + [f"{n} AS ({b})" for n, b in extra.items()]
    if not parts:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + sql


def fold_rule(cfg: CompactionConfig, messages: str) -> dict[str, str]:
    """The turn-end recurrence as a recursive table ``r`` with one row per turn end."""
    keep = cfg.keep_last
    fires = (
        f"(te.n - r.s > {keep} AND ((te.kept - r.chars) // {cfg.chars_per_token} > {cfg.max_tokens} "
        f"OR te.n - r.s > {cfg.max_messages}))"
    )
    return {
        "pre": f"""
            SELECT thread_id, position, type = 'ai' AND n_calls = 0 AS is_end,
              (sum(coalesce(length(content), 0)) OVER (PARTITION BY thread_id ORDER BY position
                 ROWS BETWEEN UNBOUNDED PRECEDING AND {keep} PRECEDING))::BIGINT AS kept
            FROM {messages}""",
        "te": """
            SELECT thread_id, position + 1 AS n, coalesce(kept, 0) AS kept,
              row_number() OVER (PARTITION BY thread_id ORDER BY position) AS k
            FROM pre WHERE is_end""",
        "r": f"""
            SELECT thread_id, 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS s, 0::BIGINT AS chars,
              false AS fired, 0::BIGINT AS before, 0::BIGINT AS folds
            FROM (SELECT DISTINCT thread_id FROM te)
            UNION ALL
            SELECT te.thread_id, te.k, te.n, CASE WHEN {fires} THEN te.n - {keep} ELSE r.s END,
              CASE WHEN {fires} THEN te.kept ELSE r.chars END, {fires}, r.s,
              r.folds + CASE WHEN {fires} THEN 1 ELSE 0 END
            FROM r JOIN te ON te.thread_id = r.thread_id AND te.k = r.k + 1""",
    }


def edited_fold_rule(cfg: CompactionConfig) -> dict[str, str]:
    """The rule over a log with edits: the thread as it stood at each new message that ends a turn."""
    keep = cfg.keep_last
    tail = f"list_sum(te.chars[er.s + 1 : te.n - {keep}])"
    fires = (
        f"(te.n - er.s > {keep} AND (coalesce({tail}, 0) // {cfg.chars_per_token} > {cfg.max_tokens} "
        f"OR te.n - er.s > {cfg.max_messages}))"
    )
    return {
        "el": """
            SELECT thread_id, position * 10 + step AS seq, step IN (5, 64) AS gone, message_id, type = 'ai' AND n_calls = 0 AS is_end,
              coalesce(length(content), 0) * CASE WHEN step = 33 THEN 2 ELSE 1 END AS chars
            FROM lm, (VALUES (0), (5), (7), (33), (64)) s(step)
            WHERE step = 0 OR (step = 5 AND position % 7 = 5) OR (step = 7 AND position % 7 = 5 AND thread_id::BIGINT % 2 = 0)
              OR (step = 33 AND position % 7 = 2) OR (step = 64 AND position % 11 = 1)""",
        "einf": """
            SELECT *, count(*) FILTER (gone) OVER (PARTITION BY thread_id, message_id ORDER BY seq) AS life FROM el""",
        "eborn": """
            SELECT *, min(seq) FILTER (NOT gone) OVER (PARTITION BY thread_id, message_id, life) AS born FROM einf""",
        "easof": """
            SELECT b.thread_id, b.seq AS upto, e.message_id, max(e.born) AS born, arg_max(e.chars, e.seq) AS chars, arg_max(e.gone, e.seq) AS gone
            FROM eborn b JOIN eborn e ON e.thread_id = b.thread_id AND e.seq <= b.seq
            WHERE NOT b.gone AND b.is_end AND b.seq = b.born GROUP BY b.thread_id, b.seq, e.message_id""",
        "elive": """
            SELECT a.* REPLACE (l.born AS born) FROM easof a JOIN (
              SELECT b.thread_id, b.seq AS upto, e.message_id, arg_max(e.born, e.seq) AS born FROM eborn b
              JOIN eborn e ON e.thread_id = b.thread_id AND e.seq <= b.seq GROUP BY 1, 2, 3) l
            ON l.thread_id = a.thread_id AND l.upto = a.upto AND l.message_id = a.message_id WHERE NOT a.gone""",
        "te": """
            SELECT thread_id, upto AS seq, count(*) AS n, list(chars ORDER BY born) AS chars,
              row_number() OVER (PARTITION BY thread_id ORDER BY upto) AS k
            FROM elive GROUP BY thread_id, upto""",
        "er": f"""
            SELECT thread_id, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS n, 0::BIGINT AS s, false AS fired, 0::BIGINT AS folds
            FROM (SELECT DISTINCT thread_id FROM te)
            UNION ALL
            SELECT te.thread_id, te.k, te.seq, te.n, CASE WHEN {fires} THEN te.n - {keep} ELSE er.s END, {fires},
              er.folds + CASE WHEN {fires} THEN 1 ELSE 0 END
            FROM er JOIN te ON te.thread_id = er.thread_id AND te.k = er.k + 1""",
    }


def candidates(cfg: CompactionConfig, messages: str, summaries: str) -> str:
    keep = cfg.keep_last
    return f"""
        SELECT * FROM (
          SELECT thread_id, s AS start, n - s AS tail_messages, n - s - {keep} AS foldable_messages,
            (sum(CASE WHEN position >= s AND position < n - {keep} THEN coalesce(length(content), 0) ELSE 0 END)
               // {cfg.chars_per_token})::BIGINT AS tokens
          FROM (SELECT x.*, coalesce(summarized_count, 0)::BIGINT AS s,
                  count(*) OVER (PARTITION BY x.thread_id) AS n
                FROM {messages} x LEFT JOIN {summaries} y ON y.thread_id = x.thread_id)
          WHERE n - s > {keep} GROUP BY thread_id, s, n)
        WHERE tokens > {cfg.max_tokens} OR tail_messages > {cfg.max_messages}"""


def part(page: str, pages: str) -> str:
    return (f"{text(W.part_lead)} || ({page} + 1)::VARCHAR || {text(W.part_of)} || ({pages})::VARCHAR"
            f" || {text(W.part_end)}")


def segments(cfg: CompactionConfig, messages: str, summaries: str, page_bytes: int = PAGE_BYTES) -> dict[str, str]:
    return {
        "cand": candidates(cfg, messages, summaries),
        "line": f"""
            SELECT c.thread_id, x.position, c.start + c.foldable_messages AS summarized_count,
              upper(x.type) || ': ' || coalesce(x.content, {text(NON_TEXT)}) AS line
            FROM cand c JOIN {messages} x ON x.thread_id = c.thread_id AND x.position >= c.start
              AND x.position < c.start + c.foldable_messages""",
        "packed": f"""
            SELECT *, dense_rank() OVER (PARTITION BY thread_id ORDER BY bin) - 1 AS page FROM (
              SELECT *, ((sum(strlen(line) + 1) OVER (PARTITION BY thread_id ORDER BY position
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - strlen(line) - 1)::BIGINT // {page_bytes} AS bin
              FROM line)""",
        "seg": f"""
            SELECT p.thread_id, page, (max(page) OVER (PARTITION BY p.thread_id)) + 1 AS pages,
              coalesce(y.summary, '') AS existing, transcript, p.summarized_count
            FROM (SELECT thread_id, page, string_agg(line, E'\\n' ORDER BY position) AS transcript,
                    any_value(summarized_count) AS summarized_count FROM packed GROUP BY thread_id, page) p
            LEFT JOIN {summaries} y ON y.thread_id = p.thread_id""",
        "fold": f"""
            SELECT *, CASE WHEN existing = '' THEN {text(W.fresh_lead)}
                ELSE {text(W.update_lead)} || existing || {text(W.update_join)} END
                || {part('page', 'pages')} || transcript || {text(W.prompt_tail)} AS prompt FROM seg""",
    }


def merged_digests(rounds: int, fan_in: int) -> tuple[str, dict[str, str]]:
    """Digests of the prompts in ``fold``, merged ``fan_in`` at a time for some rounds."""
    steps = {"merged0": "SELECT thread_id, page, pages, summarized_count, sha256(prompt) AS summary FROM fold"}
    for i in range(1, rounds + 1):
        page, pages = f"page // {fan_in}", f"(pages + {fan_in - 1}) // {fan_in}"
        steps[f"merged{i}"] = f"""
            SELECT thread_id, {page} AS page, {pages} AS pages, summarized_count,
              CASE WHEN count(*) = 1 THEN any_value(summary) ELSE sha256({text(W.merge_lead)} || {part(page, pages)}
                || string_agg(summary, {text(W.section_rule)} ORDER BY merged{i - 1}.page) || {text(W.prompt_tail)}) END AS summary
            FROM merged{i - 1} GROUP BY thread_id, {page}, {pages}, summarized_count"""
    return f"SELECT thread_id, summary, summarized_count FROM merged{rounds}", steps


COMPOSITION = """
    SELECT x.thread_id, position + 1 AS turn_index, CASE WHEN type = 'human' THEN 'user' ELSE 'assistant' END AS role,
      length(shown)::BIGINT AS length,
      (sum(length(shown)) OVER (PARTITION BY x.thread_id ORDER BY position))::BIGINT AS cumulative_chars,
      contains(shown, '[Attached image') AS has_image_note,
      position < coalesce(summarized_count, 0) AS is_summarized,
      CASE WHEN summarized_count > 0 THEN summarized_count + 0.5::DOUBLE END AS boundary
    FROM {0} x LEFT JOIN {1} y ON y.thread_id = x.thread_id"""

CHECKPOINTS_BY_THREAD = """
    SELECT ck.thread_id, coalesce(usess.title, ck.thread_id) AS title, usess.username, count(*) AS checkpoint_count
    FROM ck {0} JOIN usess ON usess.thread_id = ck.thread_id {1} GROUP BY ck.thread_id, usess.title, usess.username"""
TOP = " ORDER BY checkpoint_count DESC, thread_id LIMIT 15"
ONE_USER = "WHERE usess.username = 'user_3'"


def overview(where: str) -> str:
    inner = where.replace("WHERE username", "WHERE usess.username")
    return f"""
        SELECT (SELECT count(*) FROM acct) AS users, (SELECT count(*) FROM usess {where}) AS chats,
          (SELECT count(*) FROM ck JOIN usess ON usess.thread_id = ck.thread_id {inner}) AS checkpoints,
          (SELECT count(*) FROM prof {where}) AS profiles"""


def notes_text(header: str, line: str) -> str:
    return f"""
        SELECT profile_id, 0::BIGINT AS page, {text(header)} || E'\\n' ||
          string_agg({line}, E'\\n' ORDER BY created_at, note_id) AS text
        FROM lnote GROUP BY profile_id"""


ID_LINE, PLAIN_LINE = "'- [id: ' || note_id || '] ' || text", "'- ' || text"
ACTIVE = """
    SELECT thread_id, title, created_at, updated_at, message_count, username FROM {0}
    QUALIFY row_number() OVER (PARTITION BY username ORDER BY updated_at DESC, thread_id) = 1"""
LIVE_NOTE = "SELECT profile_id, note_id, text, created_at FROM lnote"
FOLDED_COLUMNS = "SELECT thread_id, position, message_id, type, content FROM ({0})"
REPORTED = ("customer", "documents", "events", "conversations", "labels")
MERGED, MERGE_STEPS = merged_digests(8, 4)
BOUNDARIES = """
    SELECT thread_id, folds AS boundary_no, n AS at_message, before AS previous_count, s AS summarized_count
    FROM r WHERE fired"""

ORACLES: dict[str, str] = {
    "load_tables": q("SELECT thread_id, title, created_at, updated_at, message_count, 'default_user' AS username FROM usess"),
    "load_all_tables": q("""
        SELECT 'user_account' AS table_name, 'created_at' AS last_column, count(*) AS rows, count(created_at) AS last_column_filled FROM acct
        UNION ALL SELECT 'profile', 'username', count(*), count(*) FROM prof
        UNION ALL SELECT 'session', 'username', count(*), count(*) FROM usess
        UNION ALL SELECT 'message_event', 'ts', count(*), count(*) FROM ev
        UNION ALL SELECT 'message', 'ts', count(*), count(ts) FROM m
        UNION ALL SELECT 'summary_context', 'updated_at', count(*), count(updated_at) FROM summ
        UNION ALL SELECT 'note_event', 'seq', (SELECT count(*) FROM note) * 2 - count(*), (SELECT count(*) FROM note) * 2 - count(*) FROM lnote
        UNION ALL SELECT 'note', 'source_thread_id', count(*), count(source_thread_id) FROM note
        UNION ALL SELECT 'checkpoint', 'ts', count(*), count(ts) FROM ck"""),
    "append_log": q("SELECT CAST(ts AS DATE) AS dt, op, count(*) AS events FROM sev GROUP BY ALL"),
    "upsert_latest": q("""
        SELECT coalesce(u.thread_id, s.thread_id) AS thread_id, coalesce(u.message_id, s.summary) AS summary,
          coalesce(u.position::INTEGER, s.summarized_count) AS summarized_count, coalesce(u.ts, s.updated_at) AS updated_at
        FROM (SELECT thread_id, message_id, position, ts FROM m WHERE type = 'human'
              QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY ts DESC) = 1) u
        FULL JOIN summ s ON s.thread_id = u.thread_id"""),
    "insert_if_absent": q("""
        SELECT thread_id, title, created_at, updated_at, message_count, username FROM usess
        UNION ALL
        SELECT user_id::VARCHAR, 'New Chat', min(ts), min(ts), 0, 'default_user' FROM events
        WHERE user_id % 5 = 0 GROUP BY user_id"""),
    "ensure_profiles": q("""
        SELECT profile_id, name, created_at, updated_at, username FROM prof
        UNION ALL SELECT 'default', 'Default', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01', 'default_user'
        UNION ALL SELECT sha256('profile:' || username), 'Default', created_at, created_at, username FROM acct"""),
    "register_accounts": q("""
        SELECT username, created_at FROM acct
        UNION ALL SELECT username, min(created_at) FROM usess GROUP BY username"""),
    "entity_fold": q("""
        SELECT thread_id, CASE WHEN renamed > born THEN new_title ELSE 'New Chat' END AS title, born_ts AS created_at,
          CASE WHEN patched > born THEN patch_ts ELSE born_ts END AS updated_at,
          CASE WHEN touched > born THEN counted ELSE 0 END AS message_count
        FROM (SELECT thread_id, min(seq) FILTER (op = 'create') AS born,
                arg_min(ts, seq) FILTER (op = 'create') AS born_ts,
                max(seq) FILTER (op = 'rename') AS renamed, arg_max(title, seq) FILTER (op = 'rename') AS new_title,
                max(seq) FILTER (op = 'touch') AS touched, arg_max(message_count, seq) FILTER (op = 'touch') AS counted,
                max(seq) FILTER (op IN ('rename', 'touch')) AS patched,
                arg_max(ts, seq) FILTER (op IN ('rename', 'touch')) AS patch_ts
              FROM (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY thread_id) AS gone FROM sev)
              WHERE gone IS NULL OR seq > gone GROUP BY thread_id)
        WHERE born IS NOT NULL"""),
    "profile_fold": q("""
        SELECT thread_id AS profile_id,
          CASE WHEN renamed > born THEN new_name WHEN born % 2 = 0 THEN 'Profile ' || born::VARCHAR ELSE 'New Profile' END AS name,
          born_ts AS created_at, CASE WHEN patched > born THEN patch_ts ELSE born_ts END AS updated_at,
          'user_' || (thread_id::BIGINT % 7)::VARCHAR AS username
        FROM (SELECT thread_id, min(seq) FILTER (op = 'create') AS born, arg_min(ts, seq) FILTER (op = 'create') AS born_ts,
                max(seq) FILTER (op = 'rename') AS renamed, arg_max(title, seq) FILTER (op = 'rename') AS new_name,
                max(seq) FILTER (op IN ('rename', 'touch')) AS patched,
                arg_max(ts, seq) FILTER (op IN ('rename', 'touch')) AS patch_ts
              FROM (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY thread_id) AS gone FROM sev)
              WHERE gone IS NULL OR seq > gone GROUP BY thread_id)
        WHERE born IS NOT NULL"""),
    "cascade_delete": q("""
        SELECT table_name, thread_id, count(*) AS rows FROM (
          SELECT 'session' AS table_name, thread_id FROM sess
          UNION ALL SELECT 'summary_context', thread_id FROM summ
          UNION ALL SELECT 'message_event', thread_id FROM ev
          UNION ALL SELECT 'message', thread_id FROM m
          UNION ALL SELECT 'checkpoint', thread_id FROM ck)
        WHERE thread_id NOT IN (SELECT thread_id FROM sess WHERE message_count < 4) GROUP BY ALL"""),
    "delete_profiles": q("SELECT profile_id, username, ts, outcome FROM pdec"),
    "notes_after_profile_delete": q("""
        SELECT p.profile_id, any_value(name) AS name, count(n.note_id) AS note_count, any_value(updated_at) AS updated_at
        FROM prof p LEFT JOIN note n ON n.profile_id = p.profile_id
        WHERE p.profile_id NOT IN (SELECT profile_id FROM pdec WHERE outcome = 'deleted') GROUP BY p.profile_id"""),
    "delete_notes": q("SELECT profile_id, note_id, text, created_at, source_thread_id FROM lnote"),
    "evolve_schema": q("""
        SELECT profile_id, CASE WHEN starts_with(profile_id, 'src') THEN name ELSE 'Default' END AS name,
          created_at, updated_at, 'default_user' AS username FROM prof"""),
    "integrity_audit": q("""
        SELECT 'note' AS table_name, 'primary_key' AS violation, profile_id || '/' || note_id AS row_key FROM note
        WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
        UNION ALL SELECT 'summary_context', 'not_null:summary', thread_id FROM summ WHERE summary = ''
        UNION ALL SELECT 'summary_context', 'foreign_key:thread_id', thread_id FROM summ
          WHERE thread_id NOT IN (SELECT thread_id FROM usess)
        UNION ALL SELECT 'checkpoint', 'foreign_key:thread_id', thread_id || '/' || checkpoint_id FROM ck
          WHERE thread_id NOT IN (SELECT thread_id FROM usess)"""),
    "compact_log": q(LIVE_NOTE),
    "scope_to_user": q("SELECT * FROM sess WHERE username = 'user_3'"),
    "compact_days": q(f"""
        SELECT dt, thread_id, op, seq FROM aged
        WHERE NOT stale OR dt NOT IN (SELECT dt FROM aged GROUP BY dt HAVING avg(stale::INTEGER) >= {LEAST_SHARE})""",
        aged="SELECT *, CAST(ts AS DATE) AS dt, seq < max(seq) OVER (PARTITION BY thread_id) AS stale FROM sev"),
    "search_titles": q("SELECT thread_id, title FROM sess WHERE regexp_matches(title, '^[a-m].*(an|er)', 'i')"),
    "search_notes_indexed": q("SELECT profile_id, note_id FROM note WHERE regexp_matches(text, 'th(e|in)\\s+[aeiou]', 'i')"),
    "search_notes": q("SELECT profile_id, note_id FROM note WHERE regexp_matches(text, 'th(e|in)\\s+[aeiou]', 'i')"),
    "lookup_with_default": q("""
        SELECT t.thread_id, t.profile_id, coalesce(p.name, 'Unknown Profile') AS name, coalesce(u.title, 'New Chat') AS title,
          coalesce(s.summary, '') AS summary, coalesce(s.summarized_count, 0) AS summarized_count
        FROM tprof t LEFT JOIN prof p ON p.profile_id = t.profile_id AND p.username <> 'user_3'
        LEFT JOIN usess u ON u.thread_id = t.thread_id LEFT JOIN summ s ON s.thread_id = t.thread_id"""),
    "message_text": q("SELECT message_id, shown AS text, contains(shown, '[Attached image') AS has_image_note FROM m"),
    "describe_images": q("""
        SELECT message_id, CASE WHEN block_text IS NULL THEN content
          ELSE CASE WHEN conv_id % 2 = 0 THEN block_text ELSE '' END
               || E'\\n\\n[Attached image - vision analysis: seen ' || message_id || ']' END AS content FROM m"""),
    "visible_messages": q(
        "SELECT thread_id, position, CASE WHEN type = 'human' THEN 'user' ELSE 'assistant' END AS role, message_id"
        f" FROM ({folded('tev')}) WHERE type <> 'tool'"),
    "normalize_username": "SELECT c_custkey, lower(c_name) AS username FROM customer",
    "pseudonymize": q("""
        SELECT thread_id, title, created_at, updated_at, message_count, sha256('pepper:' || username) AS username FROM sess"""),
    "auto_title": q("SELECT thread_id, title FROM sess"),
    "auto_title_with_image": q("SELECT thread_id, title FROM sess"),
    "note_fields": q("""
        SELECT profile_id, note_id, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE created_at END AS created_at,
          source_thread_id FROM note"""),
    "namespace_delete": q("""
        SELECT profile_id || '/notes' AS namespace, note_id AS key FROM note
        WHERE profile_id NOT IN (SELECT profile_id FROM prof WHERE username = 'user_3')"""),
    "namespace_notes": q("SELECT 'src4/notes' AS namespace, note_id AS key, text FROM note WHERE profile_id = 'src4'"),
    "scoped_checkpoint_count": q("SELECT count(*) AS checkpoints FROM ck JOIN usess ON usess.thread_id = ck.thread_id"),
    "scoped_checkpoint_count_user": q(f"SELECT count(*) AS checkpoints FROM ck JOIN usess ON usess.thread_id = ck.thread_id {ONE_USER}"),
    "top_threads": q(CHECKPOINTS_BY_THREAD.format("LEFT", "") + TOP),
    "top_threads_user": q(CHECKPOINTS_BY_THREAD.format("LEFT", ONE_USER) + TOP),
    "session_index": q("""
        SELECT sess.*, coalesce(summ.summary, '') <> '' AS has_summary
        FROM sess LEFT JOIN summ ON summ.thread_id = sess.thread_id"""),
    "profile_note_counts": q("""
        SELECT p.profile_id, any_value(name) AS name, count(n.note_id) AS note_count, any_value(updated_at) AS updated_at
        FROM prof p LEFT JOIN lnote n ON n.profile_id = p.profile_id GROUP BY p.profile_id"""),
    "mark_summarized": q("""
        SELECT x.thread_id, position, position < coalesce(summarized_count, 0) AS is_summarized
        FROM m x LEFT JOIN summ y ON y.thread_id = x.thread_id"""),
    "semi_scope": q("""
        SELECT thread_id, position, message_id FROM m
        WHERE thread_id IN (SELECT thread_id FROM sess WHERE username = 'user_3')"""),
    "thread_state_asof": q(
        f"SELECT request_id, thread_id, position, message_id, content FROM ({folded('past', 'request_id, thread_id')})",
        past="""SELECT ev.*, 'r' || ev.thread_id AS request_id FROM ev JOIN
                (SELECT thread_id, max(seq) // 2 AS half FROM ev GROUP BY thread_id) h
                ON h.thread_id = ev.thread_id AND ev.seq <= h.half"""),
    "thread_state_each_event": q(
        f"SELECT request_id, thread_id, position, message_id, length(content) AS chars FROM ({folded('past', 'request_id, thread_id')})",
        past="""SELECT ev.*, r.thread_id || '-' || r.seq AS request_id FROM ev JOIN ev r
                ON r.thread_id = ev.thread_id AND ev.seq <= r.seq"""),
    "overview_counts": q(overview("")),
    "overview_counts_user": q(overview("WHERE username = 'user_3'")),
    "checkpoint_distribution": q(CHECKPOINTS_BY_THREAD.format("LEFT", "")),
    "role_counts": q("""
        SELECT thread_id, CASE WHEN type = 'human' THEN 'user' ELSE 'assistant' END AS role, count(*) AS messages
        FROM lm GROUP BY ALL"""),
    "token_totals": q("SELECT thread_id, (sum(coalesce(length(content), 0)) // 4)::BIGINT AS tokens FROM m GROUP BY thread_id"),
    "note_metrics": q("""
        SELECT count(*) AS profiles, sum(c)::BIGINT AS notes, round_even(avg(c), 1) AS mean_notes FROM (
          SELECT p.profile_id, count(n.note_id) AS c FROM prof p LEFT JOIN lnote n ON n.profile_id = p.profile_id
          GROUP BY p.profile_id)"""),
    "thread_overview": q(
        """SELECT a.thread_id, stored, stored - coalesce(d.done, 0) AS active_window, coalesce(d.done, 0) AS summarized,
             coalesce(c.n, 0) AS chain_length, coalesce(d.done, 0) > stored AS boundary_overrun
           FROM (SELECT thread_id, count(*) AS stored FROM m GROUP BY thread_id) a
           LEFT JOIN done d ON d.thread_id = a.thread_id
           LEFT JOIN (SELECT user_id::VARCHAR AS thread_id, count(*) AS n FROM events GROUP BY user_id) c
             ON c.thread_id = a.thread_id""",
        done="""SELECT thread_id, summarized_count::BIGINT AS done FROM lsumm
                UNION ALL SELECT thread_id, summarized_count::BIGINT FROM summ
                WHERE thread_id NOT IN (SELECT thread_id FROM lsumm)"""),
    "thread_tags": q("""
        SELECT x.thread_id, coalesce(any_value(y.summary), '') <> '' AS has_summary,
          bool_or(contains(shown, '[Attached image')) AS has_images
        FROM m x LEFT JOIN summ y ON y.thread_id = x.thread_id GROUP BY x.thread_id"""),
    # File metadata is not in the views: the folder is the one that the check runs on (catalog/check.py puts in its own).
    "table_report": f"""
        WITH sizes AS (
          SELECT regexp_extract(filename, '/([a-z]+)[.]parquet', 1) AS table_name, sum(size)::BIGINT AS bytes
          FROM read_blob('{CHECKED_FOLDER}/**/*.parquet') GROUP BY 1),
        counts AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in REPORTED)})
        SELECT table_name, bytes, rows, round(bytes / sum(bytes) OVER (), 6) AS share FROM sizes JOIN counts USING (table_name)""",
    "table_rows": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in REPORTED),
    "dead_rows": q(f"""
        SELECT 'message_event' AS table_name, (SELECT count(*) FROM ({folded('ev')})) AS live_rows,
          (SELECT count(*) FROM ev) - (SELECT count(*) FROM ({folded('ev')})) AS dead_rows
        UNION ALL SELECT 'note_event', (SELECT count(*) FROM lnote),
          (SELECT count(*) FROM note) + 2 * ((SELECT count(*) FROM note) - (SELECT count(*) FROM lnote))
            - (SELECT count(*) FROM note) """),
    "message_count": q("SELECT thread_id, count(*) AS message_count FROM m GROUP BY thread_id"),
    "fold_messages": q(FOLDED_COLUMNS.format(folded("ev"))),
    "notes_context": q(notes_text(W.notes_header, ID_LINE)),
    "notes_context_plain": q(notes_text(W.notes_header_plain, PLAIN_LINE)),
    "transcript": q(f"""
        SELECT thread_id, 0::BIGINT AS page, string_agg(upper(type) || ': ' || coalesce(content, {text(NON_TEXT)}),
          E'\\n' ORDER BY position) AS transcript FROM m GROUP BY thread_id"""),
    "last_human": q("""
        SELECT thread_id, position, message_id, shown AS text FROM m WHERE type = 'human'
        QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) = 1"""),
    "message_index": q("""
        SELECT thread_id, position + 1 AS turn_index, CASE WHEN type = 'human' THEN 'user' ELSE 'assistant' END AS role,
          length(shown)::BIGINT AS length FROM m"""),
    "cumulative_chars": q("""
        SELECT thread_id, position, length(shown)::BIGINT AS length,
          (sum(length(shown)) OVER (PARTITION BY thread_id ORDER BY position))::BIGINT AS cumulative_chars FROM lm"""),
    "unsummarized_tail": q("""
        SELECT x.thread_id, position, message_id FROM m x LEFT JOIN summ y ON y.thread_id = x.thread_id
        WHERE position >= coalesce(summarized_count, 0)"""),
    "foldable_split": q("""
        SELECT x.thread_id, position, message_id,
          row_number() OVER (PARTITION BY x.thread_id ORDER BY position DESC) > 6 AS foldable
        FROM lm x LEFT JOIN lsumm y ON y.thread_id = x.thread_id WHERE position >= coalesce(summarized_count, 0)"""),
    "active_session": q(ACTIVE.format("sess")),
    "active_session_after_delete": q(
        ACTIVE.format("remaining"),
        remaining=f"SELECT * FROM sess WHERE thread_id NOT IN (SELECT thread_id FROM ({ACTIVE.format('sess')}))"),
    "checkpoint_chain": q("""
        SELECT thread_id, checkpoint_id, parent_checkpoint_id,
          row_number() OVER w - 1 AS step, parent_checkpoint_id IS NOT DISTINCT FROM lag(checkpoint_id) OVER w AS parent_ok
        FROM ck WINDOW w AS (PARTITION BY thread_id ORDER BY checkpoint_id)"""),
    "truncate_from": q("""
        SELECT x.thread_id, position, CASE WHEN position >= cut THEN 'removed' ELSE 'kept' END AS side
        FROM m x LEFT JOIN (SELECT thread_id, max(position) AS cut FROM m WHERE type = 'human' GROUP BY thread_id
                            HAVING max(position) > 1) c ON c.thread_id = x.thread_id"""),
    "sessions_by_recency": q("SELECT thread_id, title, updated_at, message_count FROM sess"),
    "profiles_by_recency": q("SELECT * FROM prof"),
    "oldest_notes": q("SELECT profile_id, note_id, created_at FROM lnote"),
    "one_profile_per_user": q("""
        SELECT profile_id, name, created_at, updated_at, username FROM prof
        QUALIFY row_number() OVER (PARTITION BY username ORDER BY updated_at DESC, profile_id) = 1"""),
    "append_messages": q(FOLDED_COLUMNS.format(folded("tev"))),
    "append_messages_dense": q(FOLDED_COLUMNS.format(folded("dense"))),
    "assemble_context": q(
        f"""SELECT profile_id, NULL::VARCHAR AS thread_id, -2::BIGINT AS position, page AS part, 'system' AS type, text AS content
            FROM notes WHERE profile_id IN (SELECT profile_id FROM tprof)
            UNION ALL
            SELECT t.profile_id, t.thread_id, -1, 0, 'system',
              {text(W.summary_lead)} || nullif(y.summary, '') || {text(W.summary_tail)}
            FROM tprof t LEFT JOIN summ y ON y.thread_id = t.thread_id
            UNION ALL
            SELECT NULL, x.thread_id, position, 0, type, content FROM m x LEFT JOIN summ y ON y.thread_id = x.thread_id
            WHERE position >= coalesce(summarized_count, 0)""",
        notes=notes_text(W.notes_header, ID_LINE)),
    "assemble_context_requested": q(
        f"""SELECT t.thread_id, -1::BIGINT AS position, 0::BIGINT AS part, 'system' AS type,
              concat_ws({text(W.section_rule)}, n.text,
                {text(W.summary_lead)} || nullif(y.summary, '') || {text(W.summary_tail)}) AS content
            FROM tprof t LEFT JOIN notes n ON n.profile_id = t.profile_id LEFT JOIN summ y ON y.thread_id = t.thread_id
            WHERE (n.text IS NOT NULL OR coalesce(y.summary, '') <> '') AND t.thread_id IN (SELECT thread_id FROM opened)
            UNION ALL
            SELECT x.thread_id, position, 0, type, content FROM m x LEFT JOIN summ y ON y.thread_id = x.thread_id
            WHERE position >= coalesce(summarized_count, 0) AND x.thread_id IN (SELECT thread_id FROM opened)""",
        opened=ACTIVE.format("sess"), notes=notes_text(W.notes_header, ID_LINE)),
    "compaction_candidates": q(candidates(DEFAULTS, "lm", "lsumm")),
    "compaction_candidates_kept": q(candidates(SMALL, "lm", "lsumm")),
    "compaction_candidates_small": q(candidates(SMALL, "m", "summ")),
    "fold_segments": q(
        "SELECT thread_id, page, pages, existing, transcript, prompt, summarized_count FROM fold",
        **segments(DEFAULTS, "lm", "lsumm")),
    "fold_segments_paged": q(
        "SELECT thread_id, page, pages, existing, transcript, prompt, summarized_count FROM fold",
        **segments(SMALL, "lm", "lsumm", PAGED)),
    "apply_summaries_paged": q(MERGED, **segments(SMALL, "lm", "lsumm", PAGED), **MERGE_STEPS),
    "apply_summaries_resumed": q(MERGED, **segments(SMALL, "lm", "lsumm", PAGED), **MERGE_STEPS),
    "apply_summaries": q(
        """SELECT thread_id, substring(prompt, 1, 200) AS summary, summarized_count::INTEGER AS summarized_count,
             TIMESTAMP '2025-01-01' AS updated_at FROM fold
           UNION ALL SELECT thread_id, summary, summarized_count, updated_at FROM summ
           WHERE thread_id NOT IN (SELECT thread_id FROM fold)""",
        **segments(SMALL, "m", "summ")),
    "compaction_boundaries": q(BOUNDARIES, True, **fold_rule(DEFAULTS, "lm")),
    "compaction_boundaries_chained": q(BOUNDARIES, True, **fold_rule(BY_TOKENS, "lm")),
    "compaction_boundaries_small": q(BOUNDARIES, True, **fold_rule(SMALL, "m")),
    "message_segments": q(
        """SELECT x.thread_id, x.position, min(b.folds) AS segment
           FROM m x LEFT JOIN r b ON b.thread_id = x.thread_id AND b.fired AND x.position < b.s
           GROUP BY x.thread_id, x.position""", True, **fold_rule(SMALL, "m")),
    "route_turns": q(
        """SELECT x.thread_id, CASE WHEN arg_max(n_calls, position) > 0 THEN 'tools'
             WHEN x.thread_id IN (SELECT thread_id FROM cand) THEN 'summarize' ELSE 'end' END AS route
           FROM m x GROUP BY x.thread_id""",
        cand=candidates(SMALL, "m", "summ")),
    "dispatch_tool_calls": q("""
        SELECT thread_id, profile_id, message_id, call_no, tool_call_id, tool, action, note_id, answer FROM effects"""),
    "tool_note_events": q("""
        SELECT profile_id, note_id, action AS op, CASE WHEN action = 'put' THEN 'note from ' || message_id END AS text,
          CASE WHEN action = 'put' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS created_at,
          CASE WHEN action = 'put' THEN thread_id END AS source_thread_id, epoch_us(ts) AS seq, call_no AS sub
        FROM effects WHERE action IN ('put', 'delete')"""),
    "tool_profile_touches": q("""
        SELECT p.profile_id, name, created_at, greatest(updated_at, t.ts) AS updated_at, username
        FROM prof p LEFT JOIN (SELECT profile_id, max(ts) AS ts FROM effects WHERE action IN ('put', 'delete')
                               GROUP BY profile_id) t ON t.profile_id = p.profile_id"""),
    "extract_notes": q(f"""
        SELECT response_id, thread_id, profile_id, line_no, {strip("substring(line, 3)")} AS text FROM (
          SELECT response_id, thread_id, profile_id, generate_subscripts(string_split(body, E'\\n'), 1) - 1 AS line_no,
            {strip("unnest(string_split(body, E'\\n'))")} AS line FROM usable)
        WHERE starts_with(line, '- ') AND {strip("substring(line, 3)")} <> ''"""),
    "extraction_prompts": q(f"""
        SELECT message_id AS response_id, h.thread_id, profile_id,
          {text(W.extract_lead)} || h.shown || {text(W.extract_join)} || a.shown || {text(W.extract_tail)} AS prompt
        FROM (SELECT * FROM m WHERE type = 'human' QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) = 1) h
        JOIN (SELECT thread_id, shown FROM m WHERE type = 'ai' AND n_calls = 0
              QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) = 1) a ON a.thread_id = h.thread_id
        JOIN tprof ON tprof.thread_id = h.thread_id WHERE h.shown <> ''"""),
    "extraction_touches": q("SELECT DISTINCT profile_id FROM usable"),
    "final_responses": q(f"""
        SELECT thread_id, turn_no, coalesce(CASE WHEN {strip('answer')} <> '' THEN answer END, {text(W.no_answer)}) AS response
        FROM (SELECT thread_id, turn_no, arg_max(shown, position) FILTER (type = 'ai' AND n_calls = 0) AS answer
              FROM (SELECT *, (sum(CASE WHEN type = 'human' THEN 1 ELSE 0 END)
                     OVER (PARTITION BY thread_id ORDER BY position))::BIGINT AS turn_no FROM m)
              WHERE turn_no > 0 GROUP BY thread_id, turn_no)"""),
    "regenerate": q(
        """SELECT thread_id, position, message_id, content FROM state
             WHERE position < coalesce(cut, 1e9)
           UNION ALL SELECT e.thread_id, coalesce(any_value(cut), count(s.message_id)), 'edit-' || e.thread_id,
             'edited question in ' || e.thread_id
           FROM edit e LEFT JOIN state s ON s.thread_id = e.thread_id GROUP BY e.thread_id""",
        state=f"""SELECT *, max(CASE WHEN type = 'human' THEN position END) OVER (PARTITION BY thread_id) AS cut
                  FROM ({folded('ev')})"""),
    "context_size_per_turn": q(
        """SELECT thread_id, k AS turn_no, n - 1 AS stored, before AS summarized,
             n - 1 - before + CASE WHEN before > 0 THEN 1 ELSE 0 END AS seen, false AS opens_on_tool, 0::BIGINT AS note_tokens
           FROM r WHERE k > 0""", True, **fold_rule(DEFAULTS, "lm")),
    "message_composition": q(COMPOSITION.format("m", "summ")),
    "message_composition_long": q(COMPOSITION.format("lm", "lsumm")),
    "stream_thread_state_log": q(
        f"""SELECT e.thread_id, count(DISTINCT f.message_id) AS message_count, max(e.ts) AS updated_at
            FROM ev e LEFT JOIN ({folded('ev')}) f ON f.thread_id = e.thread_id AND f.message_id = e.message_id
            GROUP BY e.thread_id"""),
    "stream_thread_state": q("SELECT thread_id, count(*) AS message_count, max(ts) AS updated_at FROM lm GROUP BY thread_id"),
    "stream_compaction": q(
        "SELECT thread_id, 'fold' AS kind, folds AS boundary_no, n AS at_message, s AS summarized_count FROM r WHERE fired",
        True, **fold_rule(DEFAULTS, "lm")),
    "stream_compaction_log": q(
        "SELECT thread_id, 'fold' AS kind, folds AS boundary_no, n AS at_message, s AS summarized_count, seq FROM er WHERE fired",
        True, **edited_fold_rule(SMALL)),
    "stream_notes": q("""
        SELECT 'src' || thread_id AS profile_id, sha256(thread_id || ':' || message_id || '-c0') AS note_id,
          'note from ' || message_id AS text, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at,
          thread_id AS source_thread_id FROM lm WHERE n_calls > 0"""),
    "stream_message_snapshot": q("""
        SELECT thread_id, message_id, seq, type, content, ts FROM (
          SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY thread_id, message_id ORDER BY seq DESC) = 1)
        WHERE op <> 'remove'"""),
    "stream_dedup": q("SELECT thread_id, message_id FROM lm"),
    "stream_final_responses": q("""
        SELECT thread_id, message_id, shown AS response FROM lm WHERE type = 'ai' AND n_calls = 0"""),
    "readonly_sql": q("""
        SELECT thread_id, title, created_at, updated_at, message_count, username FROM sess
        ORDER BY updated_at DESC, thread_id LIMIT 10"""),
}
ORACLES |= {f"{name}_split": ORACLES[name] for name in SCANS}
