"""trefoil: conjunctive graph-pattern analytics over triple tables on Spark."""

from .operators.bgp import bgp, bgp_count, bgp_grouped
from .operators.bloom import Blooms, bloom_filter_rows, build_blooms, load_blooms, save_blooms
from .operators.graph import Graph, compact_property, exclude, union_properties
from .operators.numbering import global_rank, repeat_rows
from .operators.pattern import pattern
from .operators.reduction import (
    Reductions, StoredReductions, best_reduction, materialize_reductions, reduce_property, reduced, reduction_report,
)
from .operators.statistics import graph_stats, properties, property_stats
from .operators.unbound import (
    candidate_properties, candidate_properties_by_join, intersect_candidates, verified_properties,
)
from .plans.comparison import cold_queries, mean_time_by_class, mean_time_by_joins, mean_time_by_size, rank_aligned
from .plans.mining import frequent_patterns, similar_properties
from .plans.order import join_order
from .plans.runner import answer_count, run_workload
from .plans.texts import LoggedQuery, extract_patterns, logged_queries, query_heads, rejected_queries
from .plans.workload import (
    candidate_signatures, join_pairs, join_variables, pattern_lists, query_features,
    reduction_signatures, sample_properties, sample_slices, warm_cold, workload_sample,
)
from .sources.lines import numbered_lines, zip_lines
from .sources.querylog import read_query_batch, read_query_log
from .sources.runs import read_runs, read_times, write_runs
from .sources.triples import clean_triples, parse_triples, read_triples, read_vp, write_vp

__all__ = [n for n in dir() if not n.startswith("_")]
