"""Constants of the corpus operators."""

# Token pattern, scoring weights, word lists and limits that results depend on.
TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)+\.?|[a-z0-9]+(?:-[a-z0-9]+)+|[a-z0-9]+"
# The same tokens without a step back, for engines with possessive quantifiers.
TOKEN_POSSESSIVE = r"[a-z0-9]++(?:(?:\.[a-z0-9]++)++\.?|(?:-[a-z0-9]++)++)?+"
K1, B, HEADLINE_BOOST = 1.5, 0.75, 3.0
FULL_HEAD_BONUS, BREVITY_PENALTY, MAIN_CONTINUITY_BONUS, ENTITY_PAGE_BONUS, NOTABILITY_WEIGHT = 12.0, 2.4, 5.0, 6.0, 1.5
ENTITY_DF_RATIO = 0.15
QUESTION_WORDS = tuple(
    """
who what when where which why how whose whom is are was were be been am do does did
the a an of in on at to for by from with and or as tell me about show give
create created creates make made makes name named call called
detail details explain describe please you your know more anything rundown
info information he she they him her his their them have has had can could
would should want need much many some any this that these those there here
""".split()
)
QUERY_NOISE = tuple(
    """
who what when where which why how whose whom is are was were be been am
do doe did done have ha had can could would should will
of in on at to for from with and or as by about
tell me my you your show give know more please
created create creates creator creators made wrote drew designed
appeared appear appears debut debuted
detail details explain explains describe describes rundown
happen happened happens occur occurred occurs
variant variants version versions incarnation incarnations
he she it they him her them his hers their theirs its this that these those
anything everything something really actually exactly just like
not no nor again then now go going went try tried think thought
dont doesnt didnt cant wont isnt arent nope yes yeah ok okay sure
ask asked asking else i right wrong s
""".split()
)
ARTICLES = ("the", "a", "an")
MIN_FIELDS, EXTRA_TOKENS, NOTABLE_SIZE_RATIO, NAMES_KEPT, LEGACY_KEPT = 3, 1, 5, 8, 24
PROV_IDENTITY, PROV_CODENAME, PROV_ALIAS = 2, 1, 0
SEPARATOR, MIN_FILE_BYTES, MIN_BLOCK_CHARS, MIN_SENTENCE_CHARS = "=" * 60, 1000, 200, 40
STOP_SECTIONS = ("History:", "Synopsis")
CONTEXT_CHARS, RECORD_CHARS, CLIP_CHARS = 2400, 900, 260
AMBIGUITY_MARGIN, FLAGSHIP_MARGIN, CONFIDENCE_TO_ASK = 0.015, 0.05, 3.0
VAL_STRIDE = 200
EOS = 1
MAIN_REALITY_PREFIX = "earth-616"
