"""DuckDB SQL for the queries that SQL can express."""

from llm.licenses import RULES, SENTENCES, normal_form

_BLANK_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x : x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _licenses() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(normal_form(text))}, {quoted(name)})" for name, text in SENTENCES.items())
    rules = ", ".join(
        f"({i}, {quoted(name)}, {quoted(licence)}, {quoted('|' + '|'.join(steps) + '|')})"
        for i, (name, licence, steps) in enumerate(RULES)
    )
    return rf"""
with known(part, id) as (values {known}), rules(i, rule, licence, steps) as (values {rules}),
cut as (select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text,
    '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), '\n[ \t\r]*\n', chr(1), 'g'), '\n(\p{{Lu}})', chr(1) || '\1', 'g'), chr(1)) s
  from documents),
parts as (select doc_id, unnest(s) s, unnest(range(len(s))) k from cut),
found as (select doc_id, k, id from parts join known on part = trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))),
doc as (select doc_id, string_agg(id, ',' order by k) ids, '|' || string_agg(id, '|' order by k) || '|' r from found group by doc_id),
hit as (select doc_id, rules.* from doc join rules on contains(r, steps)),
kept as (select * from hit h where not exists
  (select 1 from hit e where e.doc_id = h.doc_id and e.i < h.i and contains(e.steps, h.steps))),
lic as (select doc_id, string_agg(licence, ',' order by i) l from (select doc_id, licence, min(i) i from kept group by all) group by doc_id),
named as (select doc_id, string_agg(rule, ',' order by i) n from kept group by doc_id)
select doc_id, ids sentence_ids, coalesce(n, '') rules, coalesce(l, '') licenses
from doc left join named using (doc_id) left join lic using (doc_id)"""


def _crc32(text: str) -> str:
    """The CRC-32 of an ASCII string, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x : ascii(x)::bigint)),
  lambda c, b : list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i : case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)),
  4294967295)"""


def _repair() -> str:
    """A table of the cheapest edits (cost, letters, lines) for each state of the pattern, row by row."""
    def entry(cost: str, letters: str, lines: str) -> str:
        return f"{{'c': {cost}, 'l': {letters}, 't': {lines}}}"

    def extended(state: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
        return f"case when {state} is not null then {entry(f'{state}.c + {cost}', f'{state}.l || {letter!r}', lines)} end"

    kept = "role || ':' || text"
    # what a row makes of each state
    options = {
        "s0": ["D:s0"],
        "s1": ["D:s1", "K:s0:s"],
        "s2": ["D:s2", "K:s0:u", "K:s1:u", "K:s3:u", "R:s0:user", "R:s1:user", "R:s3:user"],
        "s3": ["D:s3", "K:s2:a", "R:s2:assistant"],
    }
    rows = []
    for state, ways in options.items():
        found = []
        for way in ways:
            letter, origin, *more = way.split(":")
            if letter == "D":
                found.append(extended(origin, "3", "D", None))
            elif letter == "K":
                found.append(f"case when not gone and initial = '{more[0]}' then {extended(origin, 'cut', 'K', kept)} end")
            else:
                line = f"'{more[0]}:' || text"
                found.append(f"case when not gone then {extended(origin, '2 + cut', 'R', line)} end")
        rows.append(f"list_min(list_filter([{', '.join(found)}], lambda x : x is not null)) {state}")
    user = [extended(s, "2", "I", "'user:'") for s in ("s0", "s1", "s3")]
    some = ["s2", *user]
    first = f"list_min(list_filter([{', '.join(some)}], lambda x : x is not null))"
    second = f"list_min(list_filter([s3, {extended('s2', '2', 'I', chr(39) + 'assistant:' + chr(39))}], lambda x : x is not null))"
    empty = entry("0::bigint", "''", "[]::varchar[]")
    nothing = "null::struct(c bigint, l varchar, t varchar[])"
    return rf"""
with recursive damaged as (
  select conv_id, turn, f, case f when 4 then 'user' else coalesce(role, ' ') end as "role",
    case f when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end text
  from (select *, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 f from conversations) where f <> 0),
doubled as (select conv_id, turn, "role", text from damaged union all select conv_id, turn, "role", text from damaged where f = 3),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, "role", left(text, 64), sha256(text)) k from doubled),
faults as (select *, left("role", 1) initial, not regexp_matches(text, '[^ 	-
]') blank,
    row_number() over (partition by conv_id, "role", text order by k) > 1 again,
    not regexp_matches(text, '[.!?][ 	-
]*$') open_end,
    lag(left("role", 1)) over (partition by conv_id order by k) before from placed),
rows_in as (select conv_id, turn, "role", text, k, initial, before, blank, not blank and again copied, not blank and not again and open_end truncated,
    blank or again gone, (not blank and not again and open_end)::int cut from faults),
summary as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, sum(blank::int)::bigint blank,
    sum(copied::int)::bigint duplicate, sum(truncated::int)::bigint truncated,
    sum((before is not null and before || initial not in ('su', 'ua', 'au'))::int)::bigint illegal, max(k) n from rows_in group by conv_id),
walk as (
  select conv_id, 0::bigint k, {empty} s0, {nothing} s1, {entry("2::bigint", "'I'", "['user:']")} s2, {entry("4::bigint", "'II'", "['user:', 'assistant:']")} s3
  from summary
  union all
  select conv_id, k, s0, s1, s2, case when s2 is null then s3 else {second} end s3 from (
    select conv_id, k, s0, s1, {first} s2, s3 from (
      select conv_id, k, s0, s1, s2, {second} s3 from (
        select w.conv_id, r.k, {", ".join(rows)} from walk w join rows_in r on r.conv_id is not distinct from w.conv_id and r.k = w.k + 1)))),
ends as (select conv_id, list_min(list_filter([s0, s3], lambda x : x is not null)) e from walk join summary using (conv_id) where k = n)
select conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, coalesce(e.c, 0) as "cost", coalesce(e.l, '') audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) left join summary using (conv_id) left join ends using (conv_id)"""


ORACLE = {
    "op12_prefix_trie": f"""
with placed as (select conv_id, coalesce("role", '') || chr(0) || coalesce(text, '') x, strlen(coalesce(text, '')) b,
    row_number() over (partition by conv_id order by turn nulls first, coalesce("role", ''), left(coalesce(text, ''), 64),
      sha256(coalesce(text, ''))) k from conversations where conv_id is not null),
members as (select conv_id, conv_id - conv_id % 5 base, {_crc32("conv_id::varchar")} % 9 h
  from (select distinct conv_id from conversations where conv_id is not null)),
lists as (select conv_id, list(x order by k) xs, list(b order by k) bs from placed group by conv_id),
rebuilt as (select m.conv_id, list_concat(coalesce(p.xs[1:h], []), coalesce(o.xs[h + 1:], [])) xs,
    list_concat(coalesce(p.bs[1:h], []), coalesce(o.bs[h + 1:], [])) bs
  from members m left join lists p on p.conv_id = base left join lists o on o.conv_id = m.conv_id),
steps as (select conv_id, d, sha256(xs[1:d]::varchar) p, case when d > 0 then bs[d] else 0 end b, d = len(xs) ends
  from (select *, unnest(range(len(xs) + 1)) d from rebuilt)),
named as (select *, min(conv_id) over (partition by d, p) node, count(*) over (partition by d, p) n from steps),
paths as (select *, lag(node) over (partition by conv_id order by d) parent from named),
nodes as (select node, d, any_value(parent) parent, any_value(n) n, any_value(b) b,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (ends) e from paths group by node, d),
kids as (select parent node, d - 1 d, count(*) c from nodes where d > 0 group by all),
full_nodes as (select *, coalesce(c, 0) nc from nodes left join kids using (node, d)),
-- each node with all nodes of the path of its smallest member down to it
above as (select u.node, u.d, v.n, v.b, v.nc from full_nodes v join paths u on u.conv_id = v.node and u.d <= v.d),
sums as (select node, d, sum((nc = 0)::int) leaves, sum((n - 1) * b) saved from above group by node, d)
select node conv_id, d "depth", parent parent_conv_id, n n_convs, nc n_children, leaves::bigint n_leaves, saved::bigint saved_tokens,
  sha256(coalesce(e, '')) ends_sha256 from full_nodes join sums using (node, d)""",
    "op11_turn_repair": _repair(),
    "op1_token_counts": rf"""
with d as (select doc_id, source, lang, text t from documents),
c as (select source, lang, v.version, case v.version when 'blank-1' then len(regexp_extract_all(coalesce(t, ''), '[^\x20\x09-\x0D]+'))
        else len(regexp_extract_all(coalesce(t, ''), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+|[!-/:-@\[-`{{-~]')) end n
      from d, (values ('blank-1'), ('split-1')) v(version))
select source, lang, version, count(*) documents, sum(n)::bigint tokens from c group by all""",
    "op3_licenses": _licenses(),
    "op8_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(regexp_replace(text, '[<\[\\]', 'xx', 'g')) n,
        length(regexp_replace(role, '[<\[\\\n]', 'xx', 'g')) m from c)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(8 + m + 1 + n + 7)::bigint formatted_chars
from e group by conv_id""",
    "op2_substrings": f"""
with d as (select doc_id, {_BLANK_WORDS} w from documents),
p as (select doc_id, unnest(range(1, len(w) - 48)) s from d where len(w) >= 50),
g as (select p.doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) h from p join d using (doc_id)),
f as (select h, min(doc_id) m from g group by h),
c as (select distinct doc_id, unnest(range(s, s + 50)) i from g join f using (h) where m < doc_id),
a as (select doc_id, list(i) r from c group by doc_id),
k as (select doc_id, len(w) n_words, coalesce(len(r), 0) n_removed,
        case when r is null then w else list_filter(list_transform(w, lambda x, i :
          case when list_contains(r, i) then null else x end), lambda x : x is not null) end v
      from d left join a using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(v, ' ')) kept_sha256 from k""",
    "op5_decontaminate": f"""
with d as (select doc_id, {_ITEM_WORDS} w from documents),
b as (select item_id, {_ITEM_WORDS} w from benchmark),
bl as (select item_id, w, least(len(w), 10) l from b where len(w) > 0),
bw as (select distinct item_id, l, array_to_string(list_slice(w, s, s + l - 1), ' ') g
       from (select *, unnest(range(1, len(w) - l + 2)) s from bl)),
dw as (select doc_id, s, l, array_to_string(list_slice(w, s, s + l - 1), ' ') g
       from (select d.*, l, unnest(range(1, len(w) - l + 2)) s from d, (select distinct l from bw))),
h as (select doc_id, s, l, item_id from dw join bw using (l, g)),
n as (select doc_id, count(distinct i) n_hit
      from (select doc_id, unnest(range(s, s + l)) i from h) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) x
      from (select distinct doc_id, cast(item_id as varchar) i from h) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(x, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join t using (doc_id)""",
}
