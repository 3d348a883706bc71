"""Fixed values. They decide results, so they are stated exactly and kept together."""

# --- fixed values: character classes (regex class bodies) ---
CJK = r"\u3040-\u30ff\u3400-\u9fff"
BIDI_CONTROLS = r"\u200e\u200f\u202a-\u202e\u2066-\u2069"
# White_Space of Unicode
WHITE = r"\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# --- fixed values: English words that end like plurals and are none ---
PLURAL_EXCEPTIONS = (
    "windows kubernetes redis postgres ios macos https http tls ssl aws gcs nfs dns bios "
    "cosmos analysis thesis basis crisis physics mathematics economics news series species "
    "means always towards perhaps plus minus canvas atlas this is was has does his its as us "
    "across us process access address status bus"
).split()

# --- fixed values: markup vocabulary ---
TEXT_EXCLUDED_TAGS = "head title script style".split()
BREAK_TAGS = (
    "address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td "
    "textarea tfoot th thead tr ul xmp"
).split()

# --- fixed values: severities of run events, least first ---
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")
