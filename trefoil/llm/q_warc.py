"""Registered query of the archive writer."""

from .common import table
from .registry import query
from .warc import read_archives, write_archives

WARC_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
),
f as (select *, min(page_id) over (partition by payload_digest) as first_page from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes < 100 or page_id = first_page then 'response' else 'revisit' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_page then first_page end as refers_to
from f"""


@query("op1_warc_revisits", WARC_SQL)
def op1_warc_revisits(spark, folder):
    path, run = write_archives(table(spark, folder, "pages").select("page_id", "url", "html"))
    return read_archives(spark, path, run).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
