"""What a table's headers say: roles, kind of dataset, confidence and warnings (on the driver)."""

from __future__ import annotations

import re

# Header aliases of each role, in the order cleaning visits them, compared without spaces, underscores and hyphens.
ALIASES = {
    "transaction_id": ("transactionid", "txnid", "orderid", "invoiceid", "invoiceno", "id"),
    "customer_id": ("customerid", "custid", "clientid", "empid", "employeeid", "userid", "memberid"),
    "customer_name": ("customername", "fullname", "name", "custname", "employeename", "patientname", "productname"),
    "country": ("country", "countryname", "nation", "region"),
    "phone_number": ("phone", "mobile", "mobileno", "mobilenumber", "contactnumber", "customerphone", "telephone", "customermobile", "phonenumber"),
    "transaction_date": ("date", "orderdate", "transactiondate", "createdat", "timestamp", "signupdate", "joined", "createdon", "signup"),
    "transaction_time": ("time", "transactiontime", "ordertime", "paymenttime"),
    "amount": ("amount", "price", "total", "totalamount", "totalprice", "transactionamount", "value", "amt"),
    "currency": ("currency", "curr", "currencycode"),
    "payment_mode": ("paymentmode", "paymentmethod", "paymenttype", "mode", "payment", "paymode"),
    "email": ("email", "emailaddress", "mail"),
}
# Headers that speak for a kind of dataset, with two points and with one.
CLUES = {
    "Customer Dataset": (("customerid", "custid", "clientid", "memberid", "customername", "clientname"), ("email", "phone", "phonenumber", "mobile")),
    "Transaction Dataset": (("transactionid", "txnid", "orderid", "invoiceid", "receiptid"), ("amount", "price", "totalamount", "paymentmode", "paymenttype", "currency")),
    "Employee Dataset": (("employeeid", "empid", "staffid", "employeename", "salary", "department", "dept", "hiredate", "jobtitle", "managerid"), ("joined", "signup", "signupdate", "createdon")),
    "Product Dataset": (("productid", "itemid", "sku", "productname", "productdesc", "stock", "quantity", "qty", "unitprice", "category"), ()),
    "Hospital Dataset": (("patientid", "patientname", "medicalid", "mrn", "doctor", "diagnosis", "roomnumber", "admissiondate", "dischargedate", "hospitalname"), ()),
}
CUSTOMER_ROLES = ("customer_id", "customer_name", "phone_number", "transaction_date", "email")
TRANSACTION_ROLES = ("transaction_id", "customer_id", "country", "phone_number", "transaction_date", "amount", "currency", "payment_mode")
EXPECTED = {
    "Customer Dataset": CUSTOMER_ROLES,
    "Transaction Dataset": TRANSACTION_ROLES,
    "Employee Dataset": ("customer_id", "customer_name", "email", "transaction_date"),
    "Product Dataset": ("amount", "transaction_id"),
    "Hospital Dataset": ("customer_id", "customer_name", "transaction_date"),
    "Mixed Dataset": ("customer_id", "transaction_date"),
}
# Headers of row identifiers, which say nothing about what a record is.
IDENTIFIERS = ("testid", "id", "rowid", "row", "rownumber", "serialnumber", "serialno", "serial", "srno", "sno", "slno", "recordid", "recordno", "index")


def normalize_header(h: str) -> str:
    return re.sub(r"[ _-]", "", h.strip().lower())


def resolve_roles(headers: list[str]) -> dict[str, str]:
    """role -> header: the first header in file order that is one of the role's aliases."""
    roles: dict[str, str] = {}
    for h in headers:
        for role, names in ALIASES.items():
            if normalize_header(h) in names and role not in roles:
                roles[role] = h
    return {r: roles[r] for r in ALIASES if r in roles}


def classify(headers: list[str]) -> str:
    seen = {re.sub(r"[ _]", "", h.strip().lower()) for h in headers}
    score = {kind: 2 * len(seen & set(two)) + len(seen & set(one)) for kind, (two, one) in CLUES.items()}
    if not any(score.values()):
        return "Unknown Dataset"
    if score["Customer Dataset"] >= 2 and score["Transaction Dataset"] >= 2:
        return "Mixed Dataset"
    return max(score, key=score.get)


def confidence(roles: dict[str, str], kind: str) -> int:
    if kind not in EXPECTED:
        return int(100 * len(roles) / len(ALIASES))
    return int(100 * sum(r in roles for r in EXPECTED[kind]) / len(EXPECTED[kind]))


def schema_warnings(roles: dict[str, str], kind: str) -> list[str]:
    customer = kind == "Customer Dataset"
    show = lambda r: "signup_date" if customer and r == "transaction_date" else r
    return [f"{show(r)} field not found" for r in (CUSTOMER_ROLES if customer else TRANSACTION_ROLES) if r not in roles]


def mandatory(kind: str) -> tuple[str, ...]:
    return CUSTOMER_ROLES if kind == "Customer Dataset" else ("transaction_id", "customer_id", "country", "phone_number", "transaction_date", "amount")


def is_identifier(header: str) -> bool:
    h = normalize_header(header)
    return h in IDENTIFIERS or h.endswith("rowid")
