"""All registered queries and their oracles."""

from pressmill.plans import analysis_plans, browse_plans, etl_plans, export_plans, lexicon_plans, page_plans, stream_plans

QUERIES, ORACLES = {}, {}
for _module in (browse_plans, analysis_plans, etl_plans, page_plans, export_plans, stream_plans, lexicon_plans):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
