"""What only larger tables show: keys whose products pass 64 bits."""

import duckdb
import pytest
from strandwise import registry

from tests.test_queries import plain

DATA = "/root/testdata/sf0.001"
#: Added to the keys of orders: line ids of such orders times 31 pass 64 bits, the ids themselves don't.
FAR = 9_000_000

WALKED = [
    "aligned_pairs", "allele_share", "base_majority", "cs_strings", "edit_distance", "edit_log", "genotype_likelihoods", "insertion_padding", "mate_overlap_quality", "md_strings", "mpileup", "msa_edges", "pileup_kmer3", "top_alleles"
]
NO_SQL = ["checksums", "msa_best_path", "region_scan", "score_chain", "snp_phase_dp", "target_regions"]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A folder with lines of late orders only, and a connection to it."""
    d = str(tmp_path_factory.mktemp("far"))
    con = duckdb.connect()
    con.execute(f"copy (select * replace (l_orderkey + {FAR} as l_orderkey) from '{DATA}/lineitem.parquet' where l_orderkey < 700) to '{d}/lineitem.parquet' (format parquet)")
    con.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
    return d, con


@pytest.mark.parametrize("name", WALKED)
def test_ids_of_late_orders_equal_sql(spark, far, name):
    d, con = far
    sql = registry.ORACLE_SQL[name].replace("rid * 31", "rid::HUGEINT * 31")  # the SQL's own product doesn't fit a BIGINT
    assert plain(registry.QUERIES[name](spark, d).toPandas()) == plain(con.execute(sql).df())


@pytest.mark.parametrize("name", NO_SQL)
def test_ids_of_late_orders_have_rows(spark, far, name):
    registry.QUERIES[name](spark, far[0]).count()
