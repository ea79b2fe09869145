"""Words that don't tell titles or abstracts apart."""

#: Fixed values.
STOP_WORDS = (
    "a an and are as at be been by for from had has have in is it its of on or our that the their these this to was were which with we "
    "study studies background objective objectives methods results conclusion conclusions abstract"
).split()
STOP_LIST_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
