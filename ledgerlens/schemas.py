"""Declared schemas. Every reader uses one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_S, _D, _L, _I = StringType(), DoubleType(), LongType(), IntegerType()
_DATE, _TS, _B = DateType(), TimestampType(), BooleanType()
_SS, _M = ArrayType(StringType()), MapType(StringType(), StringType())


def _table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


CARD_EXPENSES = _table(
    expense_id=_S,
    expense_date=_DATE,
    cardholder_id=_S,
    cardholder_name=_S,
    card_program=_S,
    card_last4=_S,
    category=_S,
    merchant=_S,
    amount=_D,
    client_count_at_time=_I,
)
BANK = _table(
    bank_account_id=_S, transaction_date=_DATE, description=_S, type=_S, amount=_D, running_balance=_D
)
RECEIPTS = _table(receipt_id=_S, receipt_date=_DATE, vendor_name=_S, amount=_D)
CLIENTS = _table(
    client_id=_S, client_name=_S, client_type=_S, aum_usd=_L, advisory_fee_pct=_D, sign_on_date=_DATE
)

GOLD = _table(txn_id=_S, source=_S, amount=_D, vendor=_S, vendor_id=_S, date=_TS)
GOLD_COLUMNS = GOLD.fieldNames()
OPTIONAL_CARD_COLUMNS = ["category", "cardholder_name", "card_last4"]

JSON_TRANSACTIONS = _table(txn_id=_S, source=_S, amount=_D, vendor=_S, vendor_id=_S, date=_TS, domain=_S)
JSON_CARDS = _table(txn_id=_S, card_number=_S, amount=_D, vendor=_S, date=_TS, category=_S)
JSON_BANK_ACCOUNTS = _table(
    txn_id=_S, account_number=_S, amount=_D, payee=_S, date=_TS, transaction_type=_S
)
JSON_EMAILS = _table(
    email_id=_S, subject=_S, sender=_S, date=_TS, body=_S, attachments=_SS, related_transactions=_SS
)
JSON_WORKFLOW_STATE = _table(
    audit_run_id=_S,
    workflow_status=_S,
    current_agent=_S,
    completed_agents=_SS,
    pending_agents=_SS,
    intermediate_results=_table(flags_created=_L, transactions_processed=_L),
    created_at=_TS,
    updated_at=_TS,
)

GROUND_TRUTH = _table(
    dataset_name=_S,
    corruption_type=_S,
    created_at=_S,
    ground_truth=_table(total_rows=_L, corrupted_rows=_L, corrupted_row_ids=_SS, corruption_details=_M),
    expected_results=_table(flags_created_min=_L, flags_created_max=_L, severity_distribution=_M),
)

KG_ENTITIES = _table(entity_id=_S, canonical_name=_S, aliases=_SS)
VENDOR_PROFILES = _table(
    vendor_id=_S,
    vendor_name=_S,
    mean_amount=_D,
    std_dev=_D,
    frequency=_D,
    typical_day_of_month=_I,
    last_transaction_date=_DATE,
)

FLAGS = _table(
    flag_id=_S,
    transaction_id=_S,
    audit_run_id=_S,
    severity_level=_S,
    confidence_score=_D,
    explanation=_S,
    factors=_SS,
    supporting_evidence_links=_S,
    reviewed=_B,
    human_decision=_S,
    reviewer_id=_S,
    review_timestamp=_TS,
    reviewer_notes=_S,
    created_at=_TS,
    updated_at=_TS,
)
AUDIT_TRAIL = _table(
    audit_run_id=_S,
    log_sequence_number=_L,
    agent_name=_S,
    tool_called=_S,
    timestamp=_TS,
    execution_time_ms=_L,
    input_data=_S,
    output_summary=_S,
    llm_model=_S,
    llm_tokens_used=_L,
    llm_cost_dollars=DecimalType(10, 4),
    error_message=_S,
    error_stack_trace=_S,
    decision_chain=_S,
)
WORKFLOW_STATE = _table(
    audit_run_id=_S,
    workflow_status=_S,
    current_agent=_S,
    completed_agents=_S,
    pending_agents=_S,
    intermediate_results=_S,
    created_at=_TS,
    updated_at=_TS,
)
