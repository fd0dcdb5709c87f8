"""Registered queries against their SQL on the smallest tables: one of each kind; the whole list is checked by the driver."""

import math

import duckdb
import pytest

from tilewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = """e1_fill e2_add e3_add_identity e4_hadamard e6_scale_columns e7_adjoint e9_lower_unit e11_permute e15_check_data j1_kernel_entries k1_thin_plate k2_matern k3_polynomial_features k4_codec_sizes j2_log_kernel
j3_admissible_weak j4_block_partition j5_range_lookup j6_matvec j6_matvec_salted j9_matmul j13_compare j14_khatri_rao a3_norm_one a9_rank_hist a10_mem_by_level a14_bench_best a14_bench_wide a15_time_summary
a17_admissible_counts w1_bisect_one_level w1_bisect_distributed w2_pca_cardinality w3_curve w4_tensor_grid w6_tiles_of w7_csr_row_ptr w8_trunc_rank w11_greedy_ranks e16_check_structure io1_read_triplets io3_raw_tensor io10_read_bench_logs
b1_to_blocks l6_aca_max l3_sum_lowrank j7_matvec_blocks j8_matvec_joined j10_matmul_lowrank l13_tsqr l17_hmatrix_matvec l19_compress_bottom_up l20_compress_top_down l24_to_uniform_and_back l25_matvec_uniform l26_nested_matvec l27_afl_1e3 l14_truncate_tall l15_randsvd_distributed l16_numerical_ranks l17_hmatrix_weak l18_sparse_partition l22_to_hodlr l24_separate_couplings l26_nested_any_depth l29_memory_plan
e6_scale_blocks e8_diagonal_blocks e10_restrict_blocks e14_half_precision e16_partition_coverage j12_matmul_block_diagonal k3_numerical_rank w5_multi_level io8_tensor_cp io9_export_clusters
f3_ldu f4_lu_hodlr f5_solve_blocks_right_upper f6_ldu_solve f8_inverse_error f9_refine_hodlr f10_svd_batched
f1_spectral_norm f2_lu_factors f6_lu_solve f5_solve_upper_general f7_invert f9_refine_single f10_eigen_batched t1_unfold_1 t3_mode_product t4_idwt3 t5_hosvd t8_hooi_error t11_mttkrp t12_cp_als t14_hierarchical_tucker""".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def _near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4))


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    got = registry.queries()[name](spark, sf)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert sorted(got.columns) == sorted(names)
    got_rows = _rows([tuple(r) for r in got.collect()], got.columns)
    want_rows = _rows(want, names)
    assert len(got_rows) == len(want_rows) > 0
    assert all(all(_near(x, y) for x, y in zip(a, b, strict=True)) for a, b in zip(got_rows, want_rows, strict=True))
