"""Schemas of the policy tables, for readers of files in these layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DDL = {
    "congress_trades": "trade_id string, member_id string, member_name string, chamber string, party string, state string, ticker string, asset_name string, transaction_type string, transaction_date date, disclosure_date date, amount_min decimal(18,2), amount_max decimal(18,2), amount_mid decimal(18,2), source_url string, created_at timestamp_ntz",
    "bills": "bill_id string, congress int, bill_type string, bill_number string, title string, summary string, introduced_date date, policy_area string, status string, source_url string",
    "bill_actions": "bill_id string, action_date date, action_type string, action_text string, chamber string",
    "bill_sponsors": "bill_id string, member_id string, role string",
    "bill_committees": "bill_id string, committee_id string",
    "members": "member_id string, name string, chamber string, party string, state string, district string, start date, end date",
    "committees": "committee_id string, name string, chamber string, parent_committee_id string",
    "member_committee_assignments": "member_id string, committee_id string, role string, start date, end date",
    "lobbying_reports": "report_id string, registrant string, client string, client_ticker string, filing_date date, period_start date, period_end date, amount decimal(18,2), issue_codes string, specific_issues string",
    "campaign_contributions": "contribution_id string, committee_name string, contributor string, employer string, ticker string, recipient_member_id string, contribution_date date, available_date date, amount decimal(18,2)",
    "federal_awards": "award_id string, recipient string, recipient_parent string, ticker string, agency string, sub_agency string, award_type string, action_date date, publication_date date, amount decimal(18,2), naics string, description string",
    "prices_daily": "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint",
    "company_master": "ticker string, name string, cik string, sector string, industry string, market_cap double, exchange string, ipo_date date",
    "entities_company": "company_id string, ticker string, cik string, name string, parent_id string, sector string, industry string, valid_from date, valid_to date",
    "company_aliases": "company_id string, alias string, source string, confidence double, manually_verified boolean",
    "entity_resolution_review": "record_id string, source string, raw_name string, candidate_company_id string, score double, status string",
    "policy_edges": "src string, dst string, edge_type string, date date, public_date date, weight double, source string",
    "predictions": "symbol string, prediction_date date, score double, probability double",
}


def schema(table: str) -> str:
    return _DDL[table]


def read(spark: SparkSession, table: str, path: str, kind: str = "parquet") -> DataFrame:
    """Files of a policy table: Parquet, JSON lines, or CSV with a header, in its schema. Rows that do not fit it fail."""
    reader = spark.read.schema(_DDL[table])
    if kind == "csv":
        return reader.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return (reader.option("mode", "FAILFAST") if kind == "json" else reader).format(kind).load(path)


def tables() -> list[str]:
    return sorted(_DDL)
