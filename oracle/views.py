"""DuckDB CTEs mirroring ``samplesmith.adapters`` (same rules, same columns)."""

from __future__ import annotations

from oracle.sqltext import NL, head, lit, one_line, pick
from samplesmith.adapters import BENCHMARKS, FILE_DIRS, FILE_EXTS, PHRASES, TASKS, TURNS


def _c(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


VIEWS: dict[str, str] = {}

VIEWS["v_samples"] = f"""
SELECT seq, 'conversations' AS dataset,
  {pick(PHRASES, 'seq % 16')} || ' ' || u_text AS instruction,
  CASE WHEN seq % 5 = 0 THEN 'See "src/app_' || {_c('seq')} || '.py" for details. ' || u_text
       WHEN seq % 5 = 1 THEN 'Source: https://github.com/org' || {_c('conv_id')} || '/repo-' || {_c('turn')} || '.git ' || u_text
       WHEN seq % 5 = 2 THEN 'path lib/mod.py ' || u_text
       WHEN seq % 5 = 3 THEN ''
       ELSE u_text END AS input,
  CASE WHEN seq % 9 = 0 THEN {lit('import os' + chr(10))} || a_text
       WHEN seq % 9 = 3 THEN {lit('```python' + chr(10) + 'def answer_')} || {_c('seq')} || {lit('(x):' + chr(10) + '    return x' + chr(10) + '```' + chr(10))} || a_text
       WHEN seq % 9 = 6 THEN 'class Answer' || {_c('seq')} || {lit(':' + chr(10) + '    pass' + chr(10))} || a_text
       WHEN seq % 3 = 1 THEN a_text
       WHEN seq % 15 = 2 THEN '' WHEN seq % 15 = 5 THEN 'Yes.' WHEN seq % 15 = 8 THEN 'Yes, done.'
       ELSE a_text END AS output
FROM (SELECT u.conv_id, u.turn, u.conv_id * {TURNS} + u.turn AS seq, u.text AS u_text, a.text AS a_text
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant')
"""

VIEWS["v_raw"] = f"""
SELECT doc_id AS seq, source AS dataset,
  CASE doc_id % 5
    WHEN 0 THEN CASE WHEN doc_id % 10 = 0 THEN NULL ELSE '' END
    WHEN 1 THEN CASE WHEN doc_id % 10 = 1 THEN NULL ELSE 'Implement: ' || split_part(text, {NL}, 1) END
    WHEN 2 THEN CASE WHEN doc_id % 10 = 2 THEN NULL ELSE 'Solve the puzzle.' END
    WHEN 3 THEN split_part(text, {NL}, 1)
    ELSE 'Summarize this text.' END AS instruction,
  CASE WHEN doc_id % 5 IN (3, 4) THEN text END AS input,
  CASE WHEN doc_id % 5 = 3 THEN text WHEN doc_id % 5 = 4 THEN split_part(text, {NL}, 1) END AS output,
  CASE WHEN doc_id % 15 = 0 THEN text WHEN doc_id % 5 = 0 THEN split_part(text, {NL}, 1) END AS prompt,
  CASE WHEN doc_id % 5 = 0 THEN text END AS completion,
  CASE WHEN doc_id % 5 = 1 THEN text END AS text,
  CASE WHEN doc_id % 5 = 1 THEN 'def f' || {_c('doc_id')} || {lit('():' + chr(10) + '    return ')} || {_c('n_chars')} END AS code,
  CASE WHEN doc_id % 5 = 2 THEN text END AS question,
  CASE WHEN doc_id % 5 = 2 THEN '["' || replace(replace(replace(text, '\\', ''), '"', ''), {NL}, ' ') || '"]' END AS solutions
FROM documents
"""

VIEWS["v_problems"] = f"""
SELECT b.item_id,
  CASE WHEN b.item_id % 7 = 6 THEN '' ELSE b.text END AS question,
  CASE WHEN b.item_id % 11 = 5 THEN '' WHEN b.item_id % 11 = 7 THEN NULL
       WHEN b.item_id % 3 = 0 THEN '["' || replace(replace(replace(b.text, '\\', ''), '"', ''), {NL}, ' ') || '", "print(1)"]'
       WHEN b.item_id % 3 = 1 THEN 'def broken(' || {_c('b.item_id')} || '): return ['
       ELSE '[]' END AS solutions,
  CASE WHEN l.quality = 1 THEN 'interview' WHEN l.quality = 0 THEN 'introductory' ELSE 'competition' END AS difficulty,
  CASE WHEN b.item_id % 4 = 0 THEN {lit('def solve():' + chr(10) + '    pass')} ELSE '' END AS starter_code
FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id
"""

_name = (f"CASE WHEN doc_id % 17 = 0 THEN 'f' || {_c('doc_id')} || '.' || {pick(FILE_EXTS, f'doc_id % {len(FILE_EXTS)}')} WHEN doc_id % 13 = 0 THEN 'build_' || {_c('doc_id')} || {pick(FILE_EXTS, f'doc_id % {len(FILE_EXTS)}')} "
         f"ELSE 'f' || {_c('doc_id')} || {pick(FILE_EXTS, f'doc_id % {len(FILE_EXTS)}')} END")
VIEWS["v_files"] = f"""
SELECT source AS repo,
  source || '/' || {pick(FILE_DIRS, f'doc_id % {len(FILE_DIRS)}')} || '/' || ({_name}) AS path,
  CAST(strlen(text) AS BIGINT) AS length,
  text AS content
FROM documents
"""

VIEWS["v_thread_items"] = f"""
SELECT conv_id AS item_id,
  split_part(text, {NL}, 1) AS title,
  CASE WHEN conv_id % 7 = 0 THEN NULL ELSE text END AS body,
  CASE WHEN conv_id % 3 = 0 THEN 'pr/' || {_c('conv_id')} END AS pull_request
FROM conversations WHERE turn = 0
"""

VIEWS["v_thread_comments"] = """
SELECT conv_id AS parent_key, turn AS ord,
  CASE WHEN turn % 11 = 5 THEN '' ELSE text END AS body
FROM conversations WHERE turn > 0
"""

_gen_text = f"""CASE WHEN event_id % 5 = 0 THEN {lit('```python' + chr(10) + 'def t')} || {_c('user_id')} || {lit('(x):' + chr(10) + '    return x + ')} || {_c('event_id')} || {lit(chr(10) + '```' + chr(10) + 'Done.')}
       WHEN event_id % 5 = 1 THEN {lit('Here:' + chr(10) + '```py' + chr(10) + 'print(')} || {_c('event_id')} || {lit(')' + chr(10) + '```')}
       WHEN event_id % 5 = 2 THEN {lit('def g(x):' + chr(10) + '    """doc' + chr(10) + '    more"""' + chr(10) + '    # comment' + chr(10) + '    return ')} || {_c('event_id')} || {lit(chr(10) + chr(10) + '// tail')}
       WHEN event_id % 5 = 3 THEN {lit('```kotlin' + chr(10) + 'fun k() = ')} || {_c('event_id')} || {lit(chr(10) + '```')}
       ELSE 'Sure! ' || props END"""
VIEWS["v_generations"] = f"""
SELECT {pick(BENCHMARKS, 'user_id % 3')} AS benchmark,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'fine_tuned' ELSE 'base' END AS model,
  user_id % {TASKS} AS task_id, event_id AS gen,
  {_gen_text} AS text,
  value > 250 AS passed,
  CASE WHEN value > 250 THEN NULL ELSE 'AssertionError: ' || event_type END AS error
FROM events
"""

VIEWS["v_tests"] = f"""
SELECT item_id AS task_id, text AS prompt,
  'assert t' || {_c('item_id')} || '(1) == 2  # ' || {one_line('text')} AS test
FROM benchmark
"""

VIEWS["v_urls"] = """
SELECT page_id * 3 AS url_id, url FROM pages
UNION ALL SELECT page_id * 3 + 1, url || '.git' FROM pages
UNION ALL SELECT page_id * 3 + 2, url || '/' FROM pages
"""

VIEWS["v_token_ids"] = f"""
SELECT conv_id * {TURNS} + turn AS id,
  list_transform(string_split(text, ' '), lambda w: CAST(length(w) + 100 AS INTEGER)) AS tokens
FROM conversations
"""

VIEWS["v_token_loss"] = """
SELECT vec_id AS id, CAST(pos - 1 AS INTEGER) AS pos,
  CAST(CASE WHEN (pos - 1) % 8 = 7 THEN -100 ELSE pos - 1 END AS INTEGER) AS label,
  abs(CAST(v AS DOUBLE)) AS nll
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
"""


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it names (and nothing else)."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes} {sql}"
