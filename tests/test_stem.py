"""Roots of English words as published with the algorithm."""

import pytest
from pyspark.sql import functions as F

from parity.check import connect
from parity.sql import stem_sql
from tillroll.functions.stem import stem

# Published pairs.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistent consist consistently consist
consolation consol consolations consol consolatory consolatori consoled consol consolidate consolid knack knack knackeries knackeri knaves knave
knavish knavish kneaded knead kneel kneel knees knee knell knell knelt knelt knew knew knightly knight knights knight knives knive knock knock knots knot knotted knot knotty knotti
running run hopping hop hoping hope happy happi sky sky skies sky dying die ties tie cries cri by by say say gas gas this this kiwis kiwi gaps gap
generously generous generate generat general general community communiti communities communiti arsenal arsenal
luxuriated luxuri hopefulness hope relational relat conditional condit rational ration digitizer digit vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis callousness callous triplicate triplic formative format formalize formal electrical electr goodness good revival reviv
allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas roll roll
news news inning inning proceed proceed early earli singly singl agreed agre feed feed plastered plaster motoring motor sing sing bled bled
sized size hissing hiss filing file falling fall boxes box mugs mug candles candl decorations decor hearts heart christmas christma glasses glass
vintage vintag lights light children children lunch lunch bags bag jumbo jumbo retrospot retrospot metal metal ceramic ceram""".split()


@pytest.fixture(scope="module")
def words():
    return dict(zip(PAIRS[::2], PAIRS[1::2]))


def test_published_roots(spark, words):
    table = spark.createDataFrame([(w,) for w in words], "word string").repartition(2)
    found = {r.word: r.root for r in table.select("word", stem(F.col("word")).alias("root")).collect()}
    assert {w: (found[w], want) for w, want in words.items() if found[w] != want} == {}


def test_the_statement_gives_the_same(spark, small, words):
    odd = ["", "a", "yy", "ayy", "eyes", "yes", "sayyid", "oed", "eing", "bed", "inging", "abilities", "organization", "enjoying", "as", "ss", "aed", "uly", "b2b", "x+y", "ogi", "allogi",
           "ative", "creative", "illi", "controll", "eee", "ied", "died", "y", "ye", "beyed", "rhythm", "crypts", "succeeds", "herrings", "4/5ing", "stemmingly", "indeedly"]
    every = sorted(set(words) | set(odd) | {w + s for w in ("play", "tap", "gener", "use", "free", "cry", "e", "hop") for s in ("s", "ed", "ing", "ly", "ness", "ful", "ize", "ization", "ement", "ion", "ies")})
    db = connect(small)
    db.execute("CREATE TABLE listed AS SELECT unnest(?::VARCHAR[]) AS word", [every])
    want = dict(db.execute(f"SELECT word, {stem_sql('word')} FROM listed").fetchall())
    found = {r.word: r.root for r in spark.createDataFrame([(w,) for w in every], "word string").select("word", stem(F.col("word")).alias("root")).collect()}
    assert found == want
