"""E-invoices: fields by a table of paths for each shape of document; what a profile doesn't carry is ``not_in_xml``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UBL, CII = "urn:oasis:names:specification:ubl:schema:xsd:", "urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:"
# Shapes by the root's name and the start of its namespace, and where each of them has a field.
SHAPES = {
    ("Invoice", UBL): {
        "doc_number": "Invoice/ID", "doc_date": "Invoice/IssueDate", "currency": "Invoice/DocumentCurrencyCode", "supplier_name": "Invoice/AccountingSupplierParty/Party/PartyLegalEntity/RegistrationName",
        "supplier_tax_id": "Invoice/AccountingSupplierParty/Party/PartyTaxScheme/CompanyID", "net_total": "Invoice/LegalMonetaryTotal/TaxExclusiveAmount", "tax_total": "Invoice/TaxTotal/TaxAmount", "gross_total": "Invoice/LegalMonetaryTotal/PayableAmount",
    },
    ("CreditNote", UBL): {
        "doc_number": "CreditNote/ID", "doc_date": "CreditNote/IssueDate", "currency": "CreditNote/DocumentCurrencyCode", "supplier_name": "CreditNote/AccountingSupplierParty/Party/PartyLegalEntity/RegistrationName",
        "supplier_tax_id": "CreditNote/AccountingSupplierParty/Party/PartyTaxScheme/CompanyID", "net_total": "CreditNote/LegalMonetaryTotal/TaxExclusiveAmount", "tax_total": "CreditNote/TaxTotal/TaxAmount", "gross_total": "CreditNote/LegalMonetaryTotal/PayableAmount",
    },
    ("CrossIndustryInvoice", CII): {
        "doc_number": "CrossIndustryInvoice/ExchangedDocument/ID", "doc_date": "CrossIndustryInvoice/ExchangedDocument/IssueDateTime/DateTimeString",
        "currency": "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeSettlement/InvoiceCurrencyCode", "supplier_name": "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeAgreement/SellerTradeParty/Name",
        "supplier_tax_id": "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeAgreement/SellerTradeParty/SpecifiedTaxRegistration/ID",
        "net_total": "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeSettlement/SpecifiedTradeSettlementHeaderMonetarySummation/TaxBasisTotalAmount",
        "tax_total": "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeSettlement/SpecifiedTradeSettlementHeaderMonetarySummation/TaxTotalAmount",
        "gross_total": "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeSettlement/SpecifiedTradeSettlementHeaderMonetarySummation/GrandTotalAmount",
    },
}
# Lines of tax within a shape: the line, and its rate, base and amount within it.
TAX_LINES = {
    "Invoice": ("Invoice/TaxTotal/TaxSubtotal", "TaxCategory/Percent", "TaxableAmount", "TaxAmount"), "CreditNote": ("CreditNote/TaxTotal/TaxSubtotal", "TaxCategory/Percent", "TaxableAmount", "TaxAmount"),
    "CrossIndustryInvoice": ("CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeSettlement/ApplicableTradeTax", "RateApplicablePercent", "BasisAmount", "CalculatedAmount"),
}
FIELDS = list(next(iter(SHAPES.values())))


def _tries() -> dict[str, dict]:
    """Of each shape a tree of element names, whose leaves have under "" what is read there: a field, or the number of a tax line's part."""
    tries: dict[str, dict] = {}
    for (shape, _), paths in SHAPES.items():
        line, *parts = TAX_LINES[shape]
        for what, path in [*paths.items(), *[(k, f"{line}/{p}") for k, p in enumerate(parts)]]:
            node = tries.setdefault(shape, {})
            for name in path.split("/")[1:]:
                node = node.setdefault(name, {})
            node.setdefault("", []).append(what)
    return tries


def _parsed(xml: str, tries: dict[str, dict]) -> tuple[str | None, dict, list[list[str]]]:
    """Shape, the text of each field's first element, and the text nodes of the parts of tax lines, from one pass over the XML.

    Prefixes are looked past, but the root's, which names its namespace.
    """
    from xml.parsers import expat

    shape, held, parts = None, {}, [[], [], []]
    nodes: list = []  # the tree's node of each open element, None beside the tree
    open_: list = []  # texts of fields whose element is open, with its depth

    def start(name, attributes):
        nonlocal shape
        prefix, _, local = name.rpartition(":")
        if not nodes:
            space = attributes.get(f"xmlns:{prefix}" if prefix else "xmlns", "")
            shape = next((n for n, known in SHAPES if n == local and (space == "" or space.startswith(known))), None)
            nodes.append(tries.get(shape))
            if shape is None:
                parser.StartElementHandler = parser.EndElementHandler = parser.CharacterDataHandler = None
            return
        node = nodes[-1].get(local) if nodes[-1] else None
        nodes.append(node)
        for what in node.get("", ()) if node else ():
            if isinstance(what, str) and what not in held:
                held[what] = []
                open_.append((len(nodes), held[what]))

    def end(name):
        while open_ and open_[-1][0] == len(nodes):
            open_.pop()
        nodes.pop()

    def text(data):
        for _, into in open_:
            into.append(data)
        for what in (nodes[-1] or {}).get("", ()) if nodes else ():
            if not isinstance(what, str):
                parts[what].append(data)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.CommentHandler = lambda _: None  # which ends a text node
    try:
        parser.Parse(xml, True)
    except (expat.ExpatError, UnicodeEncodeError):
        return None, {}, []
    return shape, {f: "".join(v).strip(" ") or None for f, v in held.items()}, parts


def read(invoices: DataFrame, key: str, xml: str) -> DataFrame:
    """key, shape, tax_lines (array of rate, base, amount texts) and the FIELDS as struct(state, value, provenance) of e-invoices.

    The root's name and namespace pick the shape. A field that the XML holds is ``present``, read ``from_xml``; one it doesn't
    hold, or holds empty, is ``not_in_xml``, never absent and never zero. XML that is null, malformed or of no known shape
    has a null shape, and its fields are null: another reader has to look at it. Each XML is parsed once, in Arrow batches.
    """
    rows = invoices.select(key, F.col(xml).alias("x"))
    tries = _tries()
    line = T.StructType([T.StructField(c, T.StringType()) for c in ("rate", "base", "amount")])
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("shape", T.StringType()), *[T.StructField(f, T.StringType()) for f in FIELDS], T.StructField("_lines", T.ArrayType(line))])
    names = schema.fieldNames()

    def parse(batches):
        from itertools import zip_longest

        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.string()) for c in ("rate", "base", "amount")]))
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                found = [_parsed(x, tries) if x else (None, {}, []) for x in batch.column("x").to_pylist()]
                lines = [[dict(zip(("rate", "base", "amount"), t, strict=True)) for t in zip_longest(*parts)] if shape else None for shape, _, parts in found]
                fields = [pa.array([held.get(f) if shape else None for shape, held, _ in found], pa.string()) for f in FIELDS]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([f[0] for f in found], pa.string()), *fields, pa.array(lines, kind)], names=names)

    def field(f: str) -> Column:
        there = F.col(f).isNotNull()
        return F.when(F.col("shape").isNotNull(), F.struct(F.when(there, "present").otherwise("not_in_xml").alias("state"), F.col(f).alias("value"), F.when(there, "from_xml").alias("provenance"))).alias(f)

    return rows.mapInArrow(parse, schema).select(key, "shape", *map(field, FIELDS), F.col("_lines").alias("tax_lines"))
