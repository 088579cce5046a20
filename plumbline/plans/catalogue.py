"""The declared rule catalogue of the five domains."""

from ..operators.declared import CheckSpec as C, FieldSpec as F

EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"

FIELDS = {
    "healthcare": {
        "patient_id": F(required=True, unique=True, pattern=r"^PAT-[0-9]{6}$"),
        "patient_name": F(required=True, case="title"),
        "ssn": F(pattern=SSN, pii=True),
        "date_of_birth": F("date", not_future=True, pii=True),
        "age": F("integer", low=0, high=130, required=True, derived_from="date_of_birth"),
        "gender": F(one_of=("Male", "Female", "Other", "Unknown"), case="title"),
        "email": F(pattern=EMAIL, pii=True),
        "phone": F(pattern=r"^\+?[0-9\-\(\) ]{10,15}$", pii=True),
        "diagnosis_code": F(required=True, pattern=r"^[A-Z][0-9]{2}\.?[0-9A-Z]{0,4}$"),
        "admission_date": F("date", not_future=True),
        "discharge_date": F("date"),
        "bill_amount": F("float", low=0.0, high=10000000.0),
        "status": F(one_of=("Active", "Discharged", "Deceased", "Transferred"), case="title"),
    },
    "finance": {
        "transaction_id": F(required=True, unique=True, pattern=r"^TXN-[0-9]{8}$"),
        "account_id": F(required=True, pattern=r"^ACC-[0-9]{7}$"),
        "customer_name": F(required=True, case="title", pii=True),
        "card_number": F(pattern=r"^[0-9]{16}$", pii=True),
        "transaction_date": F("date", not_future=True, required=True),
        "amount": F("float", required=True),
        "currency": F(one_of=("USD", "EUR", "GBP", "JPY", "CAD", "AUD"), case="upper"),
        "transaction_type": F(one_of=("Credit", "Debit", "Transfer", "Refund", "Fee"), case="title"),
        "status": F(one_of=("Completed", "Pending", "Failed", "Reversed"), case="title"),
        "balance": F("float"),
        "credit_limit": F("float", low=0.0),
    },
    "insurance": {
        "policy_id": F(required=True, unique=True, pattern=r"^POL-[0-9]{7}$"),
        "claim_id": F(unique=True, pattern=r"^CLM-[0-9]{8}$"),
        "customer_name": F(required=True, case="title", pii=True),
        "ssn": F(pattern=SSN, pii=True),
        "policy_type": F(one_of=("Health", "Life", "Auto", "Home", "Commercial"), case="title"),
        "coverage_amount": F("float", low=1000.0, required=True),
        "premium": F("float", low=0.01, required=True),
        "deductible": F("float", low=0.0),
        "policy_start": F("date", required=True),
        "policy_end": F("date", required=True),
        "claim_date": F("date"),
        "claim_amount": F("float", low=0.0),
        "claim_status": F(one_of=("Submitted", "Under Review", "Approved", "Rejected", "Settled"),
                          case="title"),
        "zip_code": F(pattern=r"^[0-9]{5}(-[0-9]{4})?$"),
    },
    "supply_chain": {
        "order_id": F(required=True, unique=True, pattern=r"^ORD-[0-9]{8}$"),
        "supplier_id": F(required=True, pattern=r"^SUP-[0-9]{5}$"),
        "supplier_name": F(required=True, case="title"),
        "product_id": F(required=True, pattern=r"^PRD-[0-9]{6}$"),
        "product_name": F(required=True),
        "category": F(one_of=("Electronics", "Machinery", "Raw Materials", "Chemicals",
                              "Food & Beverage", "Textiles", "Packaging"), case="title"),
        "order_date": F("date", not_future=True, required=True),
        "expected_delivery": F("date", required=True),
        "actual_delivery": F("date"),
        "quantity": F("integer", low=1, required=True),
        "unit_price": F("float", low=0.01, required=True),
        "total_amount": F("float", low=0.0, required=True),
        "status": F(one_of=("Ordered", "In Transit", "Delivered", "Cancelled", "Returned"),
                    case="title"),
        "quality_check": F(one_of=("Pass", "Fail", "Pending"), case="title"),
    },
    "automotive": {
        "vehicle_id": F(required=True, unique=True, pattern=r"^VEH-[0-9]{6}$"),
        "vin": F(required=True, unique=True, pattern=r"^[A-HJ-NPR-Z0-9]{17}$"),
        "make": F(required=True, one_of=("Ford", "Toyota", "Honda", "BMW", "Mercedes", "Chevrolet",
                                         "Tesla", "Nissan", "Hyundai", "Kia"), case="title"),
        "model": F(required=True),
        "year": F("integer", low=1980, high=2026, required=True),
        "mileage": F("integer", low=0, high=1000000),
        "engine_type": F(one_of=("Gasoline", "Diesel", "Electric", "Hybrid", "Plug-in Hybrid"),
                         case="title"),
        "customer_name": F(required=True, case="title", pii=True),
        "email": F(pattern=EMAIL, pii=True),
        "service_id": F(unique=True, pattern=r"^SVC-[0-9]{8}$"),
        "service_date": F("date", not_future=True),
        "service_type": F(one_of=("Oil Change", "Tire Rotation", "Brake Service", "Engine Repair",
                                  "Body Work", "Inspection", "Battery Replacement", "Other"),
                          case="title"),
        "cost": F("float", low=0.0),
        "parts_cost": F("float", low=0.0),
        "labor_cost": F("float", low=0.0),
        "warranty_status": F(one_of=("Active", "Expired", "Not Applicable"), case="title"),
    },
}

# Conditions and checks are Spark SQL over the typed view.
CHECKS = {
    "healthcare": [
        C("discharge_after_admission", "discharge_date >= admission_date", "HIGH",
          "swap_or_nullify_discharge",
          "discharge_date IS NOT NULL AND admission_date IS NOT NULL"),
        C("age_dob_consistency",
          "abs(age - floor(months_between(as_of, date_of_birth) / 12)) <= 1", "MEDIUM",
          "recalculate_age_from_dob", "date_of_birth IS NOT NULL AND age IS NOT NULL"),
        C("active_patient_requires_diagnosis", "diagnosis_code IS NOT NULL", "HIGH",
          "flag_for_review", "status = 'Active'"),
        C("bill_amount_positive", "bill_amount >= 0", "HIGH", "set_absolute_value"),
    ],
    "finance": [
        C("balance_within_credit_limit", "balance <= credit_limit", "HIGH", "flag_for_review",
          "transaction_type = 'Credit' AND credit_limit IS NOT NULL"),
        C("no_zero_amount_transaction", "amount != 0", "MEDIUM", "flag_for_removal"),
        C("failed_transaction_no_credit", "transaction_type != 'Credit'", "HIGH",
          "flag_for_review", "status = 'Failed'"),
    ],
    "insurance": [
        C("policy_end_after_start", "policy_end > policy_start", "HIGH", "flag_for_review"),
        C("claim_within_policy_period", "claim_date BETWEEN policy_start AND policy_end", "HIGH",
          "flag_for_review", "claim_date IS NOT NULL"),
        C("claim_within_coverage", "claim_amount <= coverage_amount", "MEDIUM",
          "cap_at_coverage_amount", "claim_amount IS NOT NULL"),
        C("settled_claim_has_settlement", "settlement_amount IS NOT NULL AND settlement_amount > 0",
          "HIGH", "flag_for_review", "claim_status = 'Settled'"),
        C("deductible_less_than_coverage", "deductible < coverage_amount", "MEDIUM",
          "flag_for_review"),
    ],
    "supply_chain": [
        C("total_amount_correct",
          "try_divide(abs(total_amount - quantity * unit_price), quantity * unit_price) <= 0.01",
          "HIGH", "recalculate_total"),
        C("expected_delivery_after_order", "expected_delivery > order_date", "HIGH",
          "flag_for_review"),
        C("actual_delivery_after_order", "actual_delivery >= order_date", "HIGH", "flag_for_review",
          "actual_delivery IS NOT NULL"),
        C("delivered_order_has_actual_delivery", "actual_delivery IS NOT NULL", "MEDIUM",
          "flag_for_review", "status = 'Delivered'"),
        C("cancelled_order_positive_quantity",
          "quality_check IS NULL OR quality_check = 'Pending'", "LOW", "nullify_quality_check",
          "status = 'Cancelled'"),
    ],
    "automotive": [
        C("cost_equals_parts_plus_labor", "abs(cost - (parts_cost + labor_cost)) <= 0.01", "HIGH",
          "recalculate_total_cost", "parts_cost IS NOT NULL AND labor_cost IS NOT NULL"),
        C("service_date_not_future", "service_date <= as_of", "MEDIUM", "flag_for_review",
          "service_date IS NOT NULL"),
        C("warranty_service_zero_cost", "cost <= 50", "LOW", "flag_for_review",
          "warranty_status = 'Active'"),
        C("vin_no_invalid_chars", "NOT vin RLIKE '[IOQ]'", "HIGH", "flag_for_correction"),
    ],
}

PII_FIELDS = {
    "healthcare": ["patient_name", "ssn", "date_of_birth", "email", "phone", "address"],
    "finance": ["customer_name", "card_number", "routing_number", "email", "phone", "ssn"],
    "insurance": ["customer_name", "ssn", "email", "phone", "address"],
    "supply_chain": [],
    "automotive": ["customer_name", "email", "phone"],
}
