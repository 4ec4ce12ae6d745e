"""What source text pins, on files with every case that the readers tell apart."""

from factloom.operators import pins

RUST = """pub const CACHE_GROW_SIZE: usize = 512;
pub(crate) const COALESCE_PAYBACK_STEPS: u64 = 1_000u64;
pub const GREETING: &str = "hello";
pub const DERIVED_LIMIT: usize = CACHE_GROW_SIZE * 4;
// const COMMENTED_OUT_SIZE: usize = 99;
static SWA_WINDOW: usize = 0x80;
const MAX_RATIO: f32 = -1.5e2f32;"""
C = """template <int HEAD_SIZE, int VEC_SIZE>
struct Kernel {
  static_assert(HEAD_SIZE == 128, "supports HEAD_SIZE=128, (only)");
  static_assert(VEC_SIZE % 4 == 0, "vec_size must be a multiple of 4");
  static_assert(sizeof(int) == 4);
  static_assert(HEAD_SIZE == 128 || HEAD_SIZE == 256, "128 or 256");
  // static_assert(OLD == 1, "gone");
  static_assert(
      ns::TILE == 16u,
      "two lines"
  );
};"""
PYTHON = """class V4Backend:
    def __init__(self, model_runner):
        self.page_size = model_runner.page_size
        assert (
            self.page_size == 256
        ), "the system hardcodes page_size=256"

    def plan(self):
        assert self.page_size == 256, "the system hardcodes page_size=256"

    def check(self, topk):
        assert topk == 1  # no message, (as likely a fixture
        assert self.tp_size == 8, "only # tp_size 8"
        assert x == y, "no number"
        print("an open ( in a string")
        assert n % 3 == 0, 'threes'"""


def test_pins(spark):
    files = [("lib.rs", "rust", RUST), ("kernel.cuh", "c", C), ("backend.py", "python", PYTHON)]
    rows = [(p, i + 1, x, lang) for p, lang, text in files for i, x in enumerate(text.split("\n"))]
    found = pins.pins(spark.createDataFrame(rows, "path string, line long, text string, language string"))
    got = {(r["path"], r["name"], r["predicate"]): (r["value"], r["kind"], r["line"], r["also_at"], r["message"]) for r in found.collect()}
    assert got == {
        ("lib.rs", "CACHE_GROW_SIZE", "set_to"): (512, "state", 1, [], None),
        ("lib.rs", "COALESCE_PAYBACK_STEPS", "set_to"): (1000, "state", 2, [], None),
        ("lib.rs", "SWA_WINDOW", "set_to"): (128, "state", 6, [], None),
        ("lib.rs", "MAX_RATIO", "set_to"): (-150, "state", 7, [], None),
        ("kernel.cuh", "HEAD_SIZE", "pinned_to"): (128, "constraint", 3, [], "supports HEAD_SIZE=128, (only)"),
        ("kernel.cuh", "VEC_SIZE", "divisible_by"): (4, "constraint", 4, [], "vec_size must be a multiple of 4"),
        ("kernel.cuh", "TILE", "pinned_to"): (16, "constraint", 8, [], "two lines"),
        ("backend.py", "page_size", "pinned_to"): (256, "constraint", 4, [9], "the system hardcodes page_size=256"),
        ("backend.py", "tp_size", "pinned_to"): (8, "constraint", 13, [], "only # tp_size 8"),
        ("backend.py", "n", "divisible_by"): (3, "constraint", 16, [], "threes"),
    }
