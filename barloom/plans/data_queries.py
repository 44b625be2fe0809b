"""Queries of the general data operators (p1 to p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.differences import stroke_differences
from barloom.operators.history import version_history
from barloom.operators.spikes import implausible_bars
from barloom.operators.timestamps import normalise_timestamps
from barloom.session import read_table
from barloom.sources.rejects import ALIASES, load_csv_records

QUERIES = {
    "p1_found": lambda s, d: normalise_timestamps(read_table(s, d, "feed_bars"), read_table(s, d, "feeds")),
    "p2_found": lambda s, d: version_history(read_table(s, d, "structure_snapshots")),
    "p3_found": lambda s, d: load_csv_records(read_table(s, d, "csv_lines")).where("reason is not null").select("line_id", "reason"),
    "p3_loaded": lambda s, d: load_csv_records(read_table(s, d, "csv_lines")).where("reason is null").select("line_id", "file_id", F.trim("bar_time").alias("bar_time"), "open", "high", "low", "close", "volume"),
    "p4_found": lambda s, d: stroke_differences(read_table(s, d, "strokes"), read_table(s, d, "strokes_copy")),
    "p5_found": lambda s, d: implausible_bars(read_table(s, d, "raw_bars")),
}

def _csv_sql() -> str:
    """Every record's fields by regular expressions alone, without a CSV reader."""
    field = lambda d: rf'(?:"(?:[^"]|"")*"|[^"{d}]*)'
    forms = [(",", ","), (";", ";"), ("\t", r"\t"), ("|", "|")]
    well = " ".join(f"when '{d}' then regexp_full_match(r, '(?s){field(e)}(?:[{e}]{field(e)})*')" for d, e in forms)
    cut = " ".join(f"when '{d}' then regexp_extract_all('{d}' || r, '(?s)[{e}]({field(e)})', 1)" for d, e in forms)
    place = ", ".join(f"coalesce({', '.join(f'list_position(names, {chr(39)}{a}{chr(39)})' for a in aliases)}) p_{f}" for f, aliases in ALIASES.items())
    text = lambda f: f"(case when f[p_{f}] like '\"%' then replace(f[p_{f}][2:-2], '\"\"', '\"') else f[p_{f}] end)"
    number = "'[ \\t\\n\\v\\f\\r]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \\t\\n\\v\\f\\r]*'".replace("\\\\", "\\")
    bad = lambda f: f"not coalesce(regexp_full_match({text(f)}, {number}) and try_cast(trim({text(f)}) as double) > 0, false)"
    volume = text("volume")
    return f"""
with h as (
  select file_id, n[list_position(n, list_max(n))] k, case n[1] when list_max(n) then ',' else case n[2] when list_max(n) then ';' else case n[3] when list_max(n) then chr(9) else '|' end end end d, line
  from (select file_id, line, [len(line) - len(replace(line, ',', '')), len(line) - len(replace(line, ';', '')), len(line) - len(replace(line, chr(9), '')), len(line) - len(replace(line, '|', ''))] n
    from (select file_id, rtrim(ltrim(max(line), chr(65279)), chr(13)) line from csv_lines where line_no = 1 group by file_id))),
c as (select file_id, d, list_transform(string_split(line, d), lambda x: lower(trim(replace(x, '"', '')))) names from h),
o as (select file_id, d, len(names) width, {place} from c),
x as (select line_id, l.file_id, o.* exclude (file_id), case when line like '%' || chr(13) then line[:-2] else coalesce(line, '') end r from csv_lines l left join o on l.file_id = o.file_id where line_no is distinct from 1),
y as (select *, case d {well} end well, case d {cut} end f from x)
select line_id, coalesce(case when d is null then 'columns' when not well then 'quoting' when len(f) <> width or r = '' then 'columns' {' '.join(f"when {bad(f)} then '{f}'" for f in ("open", "high", "low", "close"))}
  when trim(coalesce({volume}, '')) <> '' and (not regexp_full_match({volume}, {number}) or try_cast(trim({volume}) as double) < 0) then 'volume' end, '') reason,
  file_id, trim({text("timestamp")}) bar_time, {', '.join(f'try_cast(trim({text(f)}) as double) {chr(34)}{f}{chr(34)}' for f in ("open", "high", "low", "close", "volume"))} from y"""


_SIDE = "select symbol, trim(logical_id) lid, arg_max({{'s': start_price, 'e': end_price, 't': upper(trim(status))}}, revision) x from {0} where trim(logical_id) <> '' group by all"

SQL = {
    "p3_loaded": f"select * exclude (reason) from ({_csv_sql()}) where reason = ''",
    "p3_found": f"select line_id, reason from ({_csv_sql()}) where reason <> ''",
    "p2_found": """
with r as (
  select symbol, snapshot_bar, logical_id, revision, upper(trim(status)) status, coalesce(confirmed_at_bar, -1) c,
    row_number() over (partition by symbol, snapshot_bar, logical_id order by ingest_seq desc) k
  from structure_snapshots),
b as (
  select symbol, snapshot_bar, row_number() over (partition by symbol order by snapshot_bar) i,
    coalesce(lead(snapshot_bar) over (partition by symbol order by snapshot_bar), -1) nx
  from (select distinct symbol, snapshot_bar from r)),
o as (
  select r.*, i, nx, i - row_number() over (partition by symbol, logical_id, revision, status, c order by i) g
  from r join b using (symbol, snapshot_bar) where k = 1 and logical_id is not null)
select symbol, logical_id, min(snapshot_bar) valid_from, cast(arg_max(nx, i) as bigint) valid_to, revision, status, c confirmed_at_bar
from o group by symbol, logical_id, revision, status, c, g""",
    "p4_found": f"""
with a as ({_SIDE.format("strokes")}), b as ({_SIDE.format("strokes_copy")}),
j as (
  select coalesce(a.symbol, b.symbol) symbol, coalesce(a.lid, b.lid) logical_id, a.x ax, b.x bx, a.lid is null an, b.lid is null bn
  from a full join b on a.symbol = b.symbol and a.lid = b.lid)
select symbol, logical_id, 'missing_in_copy' difference from j where bn
union all select symbol, logical_id, 'missing_in_strokes' from j where an
union all select symbol, logical_id, 'start_price' from j where not an and not bn and (abs(ax.s - bx.s) > 0.00005 or (ax.s is null) <> (bx.s is null))
union all select symbol, logical_id, 'end_price' from j where not an and not bn and (abs(ax.e - bx.e) > 0.00005 or (ax.e is null) <> (bx.e is null))
union all select symbol, logical_id, 'status' from j where not an and not bn and ax.t is distinct from bx.t""",
    "p5_found": """
with b as (select symbol, feed, bar_index, arg_max({'h': high, 'l': low, 'c': close}, received_at) v from raw_bars group by all),
i as (select symbol, feed, bar_index, v.h h, v.l l, v.c c, coalesce(v.h < v.l, false) or coalesce(v.c > v.h, false) or coalesce(v.c < v.l, false) or coalesce(least(v.h, v.l, v.c) <= 0, false) imp from b),
x as (select *, case when c is not distinct from lag(c) over w then 0 else 1 end nw from i window w as (partition by symbol, feed order by bar_index)),
y as (select *, sum(nw) over (partition by symbol, feed order by bar_index) run from x),
z as (select symbol, feed, run, count(*) n from y where c is not null group by all),
q as (select feed, quantile_disc(n, 0.95) q95 from z group by feed),
d as (select feed, abs(c / lag(c) over (partition by symbol, feed order by bar_index) - 1) d from i where not imp and c is not null),
u as (select feed, quantile_disc(d, 0.5) u from d where d > 0 group by feed),
n as (
  select i.*, u, lag(c) over w l1, lag(c, 2) over w l2, lead(c) over w r1, lead(c, 2) over w r2, lag(h) over w hl, lead(h) over w hr, lag(l) over w ll, lead(l) over w lr
  from i join u using (feed) where not imp and c is not null window w as (partition by symbol, feed order by bar_index)),
s as (
  select symbol, bar_index, u,
    greatest(least(abs(h / l1 - 1), abs(h / r1 - 1)) * (l1 / l1) * (r1 / r1), least(abs(l / l1 - 1), abs(l / r1 - 1)) * (l1 / l1) * (r1 / r1), least(abs(c / l1 - 1), abs(c / r1 - 1)) * (l1 / l1) * (r1 / r1)) o1,
    least(greatest(least(abs(h / l1 - 1), abs(h / r2 - 1)), least(abs(l / l1 - 1), abs(l / r2 - 1)), least(abs(c / l1 - 1), abs(c / r2 - 1))),
      greatest(least(abs(hr / l1 - 1), abs(hr / r2 - 1)), least(abs(lr / l1 - 1), abs(lr / r2 - 1)), least(abs(r1 / l1 - 1), abs(r1 / r2 - 1)))) * (l1 / l1) * (r2 / r2) o2,
    least(greatest(least(abs(h / l2 - 1), abs(h / r1 - 1)), least(abs(l / l2 - 1), abs(l / r1 - 1)), least(abs(c / l2 - 1), abs(c / r1 - 1))),
      greatest(least(abs(hl / l2 - 1), abs(hl / r1 - 1)), least(abs(ll / l2 - 1), abs(ll / r1 - 1)), least(abs(l1 / l2 - 1), abs(l1 / r1 - 1)))) * (l2 / l2) * (r1 / r1) o3
  from n)
select symbol, bar_index, 'impossible' kind from i where imp
union all select symbol, bar_index, 'stuck' from y join z using (symbol, feed, run) join q using (feed) where n > 4 * q95 and not imp
union all select symbol, bar_index, 'spike' from s where greatest(coalesce(o1, 0), coalesce(o2, 0), coalesce(o3, 0)) > 25 * u""",
}
