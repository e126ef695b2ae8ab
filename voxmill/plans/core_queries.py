"""Queries over the core operators that are no plain SQL, and their oracles."""

from __future__ import annotations

from voxmill.streaming import compactor

QUERIES = {
    "p3_found": compactor.found,
    "p3_report": compactor.report,
    "p3_recordings": compactor.recordings,
}

_KEY = r"""
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url_decode(replace(
      regexp_replace(translate(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\', '/'), '^file://', ''), '+', '%2B')),
      '^([^/])', '/srv/speech/\1'), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]*[^/.][^/]*/\.\./', '/', 'g'), '/[^/]*[^/.][^/]*/\.\./', '/', 'g'), '/[^/]*[^/.][^/]*/\.\./', '/', 'g')
"""

ORACLES = {
    "p3_recordings": f"""
        with k as (
          select file_id, content,
            coalesce('a:' || {_KEY.format(c='flac_path')}, 't:' || {_KEY.format(c='txt_path')}, 'r:' || file_id) as k from speech_files),
        r as (
          select k, file_id, content, min(file_id) over (partition by k) as first_file_id, count(*) over (partition by k) as n_listed,
            row_number() over (partition by k order by content is null, file_id) as r from k)
        select first_file_id, n_listed, file_id, md5(content) as content_md5 from r where r = 1
    """,
    "p3_found": f"""
        with k as (
          select file_id, coalesce('a:' || {_KEY.format(c='flac_path')}, 't:' || {_KEY.format(c='txt_path')}) as k from speech_files)
        select a.file_id as file_id_a, b.file_id as file_id_b from k a join k b on a.k = b.k and a.file_id < b.file_id
    """,
    "p3_report": f"""
        with k as (
          select file_id, content,
            coalesce('a:' || {_KEY.format(c='flac_path')}, 't:' || {_KEY.format(c='txt_path')}, 'r:' || file_id) as k from speech_files),
        one as (select *, row_number() over (partition by k order by content is null, file_id) as r from k)
        select 0 as batch, count(*) as n_listed, count(*) filter (r = 1) as n_records,
          cast(sum(coalesce(strlen(content), 0) + 64) filter (r = 1) as bigint) as n_stored_bytes from one
    """,
}
