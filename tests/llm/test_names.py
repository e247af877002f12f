from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from pitchgrid.llm.aliases import alias_clusters, alias_pairs, candidates, players_of
from pitchgrid.llm.names import Matcher, assignment, deletes, distance, neighbour_keys, sparse_assignment, token_similarity, tokens


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_distance_against_brute_force(a, b):
    def slow(i, j):
        if not i or not j:
            return i + j
        best = min(slow(i - 1, j) + 1, slow(i, j - 1) + 1, slow(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, slow(i - 2, j - 2) + 1)
        return best

    assert distance(a, b, 9) == slow(len(a), len(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0.0, 0.3, 0.5, 0.9]), min_size=3, max_size=3), min_size=1, max_size=3))
def test_assignment_against_brute_force(w):
    total = sum(w[i][j] for i, j in assignment(w))
    best = max(sum(w[i][p[i]] for i in range(len(w))) for p in permutations(range(3), len(w)))
    assert abs(total - best) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", min_size=4, max_size=8), st.integers(0, 7))
def test_one_edit_shares_a_delete(word, at):
    at %= len(word)
    for other in (word[:at] + word[at + 1 :], word[:at] + "x" + word[at + 1 :], word[:at] + "x" + word[at:]):
        assert deletes(word) & ({other} | {other[:i] + other[i + 1 :] for i in range(len(other))})


def test_tokens_and_similarity():
    assert tokens("  José  de la O'Conór (c) ") == ("jose", "oconor")
    assert tokens("JosÃ© Koux") == ("jose", "koux")
    assert tokens(None) == () and tokens("12 ???") == ()
    assert token_similarity("s", "sebastian") > 0 and token_similarity("seb", "sebastian") > 0.7 and token_similarity("rhys", "abdoulaye") == 0


def test_players():
    m = Matcher(frozenset({"rhys", "abdoulaye", "joseph", "maximilian"}), frozenset({("max", "maximilian")}))
    names = [[("rhys", "mirtarro")], [("mirtaro", "rhys")], [("abdoulaye", "mirtarro")], [("mirtarro",)], [("r", "mirtarro")], [("maximilian", "plais")], [("plais",)], [("max", "plais", "vialquist")]]
    p = players_of(names, m)
    assert p[0] == p[1] == p[4] != p[2] and p[3] not in (p[0], p[2]) and p[5] == p[6] == p[7] != p[0]


def test_pairs(spark):
    cols = "alias_id long, id_team string, id_season string, id_competition string, observed_name string, normalized_alias string, known_as string, full_name string, id_player string, block int"
    rows = [
        (1, "T", "S", "C", "Duflo", None, None, None, None, 0), (2, "T", "S", "C", "Mic. Caxiel", None, "Duflo", "Michael Caxiel", None, 0), (3, "T", "S", "C", "Caxiel, Michael", None, None, None, None, 0),
        (4, "T", "S", "C", "Duflo", None, None, None, None, 0), (4, "T", "S", "C", "Duflo", None, None, None, None, 0), (5, None, "S", "C", "Duflo", None, None, None, None, 0), (6, "T", "S", "C", None, None, None, None, None, 0), (7, "T", "S", "C", "!!", None, None, None, None, 0),
    ]
    df = spark.createDataFrame(rows, cols)
    got = {tuple(r) for r in alias_pairs(alias_clusters(df)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert alias_pairs(alias_clusters(df.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.lists(st.sampled_from([0.0, 0.3, 0.5, 0.6, 0.9]), min_size=n, max_size=n), min_size=1, max_size=6)))
def test_sparse_assignment_against_the_small_one(w):
    got = sparse_assignment({i: {j: x for j, x in enumerate(row) if x} for i, row in enumerate(w)})
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert abs(sum(w[i][j] for i, j in got) - sum(w[i][j] for i, j in assignment(w))) < 1e-9


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=3, max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 11), st.sampled_from("abc")), max_size=3))
def test_alike_tokens_share_a_key(word, edits):
    other = word
    for kind, at, letter in edits:
        at %= len(other) or 1
        other = (other[:at] + other[at + 1 :], other[:at] + letter + other[at + 1 :], other[:at] + letter + other[at:])[kind]
    # the last rule of token_similarity, 0.45 for three letters, is below what anchors a name
    if len(other) > 2 and token_similarity(word, other) >= 0.64:
        assert neighbour_keys(word) & neighbour_keys(other)


def test_family_names_two_edits_apart_are_candidates():
    m = Matcher(frozenset({"rhys", "sebastian", "rafael"}))
    names = [[("rhys", "trocondao")], [("trocondsno", "rhys")], [("sebastian", "croonstrand")], [("sebastian", "rafael", "crontrand")], [("rhys", "kalinovicz")], [("kalin", "rhys")]]
    assert {(0, 1), (2, 3), (4, 5)} <= set(candidates(names, m))
    p = players_of(names, m)
    assert p[0] == p[1] and p[2] == p[3] and p[4] == p[5] and len(set(p)) == 3


def test_family_name_behind_the_eighth_word():
    given = ("ana", "bea", "cleo", "dora", "elsa", "fara", "gina", "hana")
    m = Matcher(frozenset(given))
    assert m.level((*given, "mirtarro"), ("ana", "mirtaro")) == 3 and m.level((*given, "mirtarro"), ("ana", "kovacs")) <= 0


def test_filter_drops_only_pairs_with_nothing_in_common():
    """Whatever :func:`may_share_a_word` and :func:`may_be_nicknames` drop has level 0; they do drop."""
    import random

    from pitchgrid.llm.names import Matcher, may_be_nicknames, may_share_a_word, nickname_bits, signatures

    rnd = random.Random(8)
    stems = ["vasovic", "zanko", "brexileiro", "tionaldo", "pelranovic", "kim", "skavissson", "marco", "paco", "francisco", "leo", "leonardo"]

    def typed(word):
        letters = list(word)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(letters))
            letters[at : at + 1] = rnd.choice([[], [rnd.choice("abcdeiklnorstvz")], [letters[at], rnd.choice("aeiou")]])
            letters = letters or ["a"]
        return "".join(letters)[: rnd.choice([1, 2, 3, 4, 20, 20, 20])]

    names = [tuple(typed(rnd.choice(stems)) for _ in range(rnd.randrange(1, 4))) for _ in range(220)]
    nick = frozenset({("francisco", "paco"), ("leo", "leonardo")})
    matcher = Matcher(frozenset({"marco"}), nick)
    first, letters = signatures(names)
    bits = nickname_bits(names, nick)
    may = may_share_a_word((first[:, None], letters[:, None]), (first[None], letters[None])) | may_be_nicknames(bits[:, None], bits[None])
    lost = [(names[i], names[j]) for i in range(220) for j in range(220) if not may[i, j] and names[i] != names[j] and matcher.level(names[i], names[j]) != 0]
    assert not lost and 0 < may.mean() < 0.5
