"""Explicit schemas of the record files; nothing is inferred in queries."""

from __future__ import annotations

_EVAL = "checkpoint_script string, training_condition string, seed int, image_path string, image_id string, ground_truth string"
_CONFIDENCE = "text string, mean_confidence double"

SCHEMAS: dict[str, str] = {
    "ground_truth": "id string, text string, language string, script string, source string, img_plain_path string, img_degraded_path string",
    "predictions": "id string, variant string, image_path string, engine string, language string, predicted_text string, confidence double, skipped_reason string",
    "error_taxonomy": "engine string, language string, image_id string, variant string, bucket string, taxonomy_label string, ground_truth string, predicted string",
    "review_notes": "language string, image_id string, variant string, engine string, ground_truth string, predicted string, label string, suggested_label string, suggested_reason string, suggestion_fits boolean, suggestion_outcome string",
    "manifest": "image_path string, text string",
    "confusions": f"{_EVAL}, misreads array<struct<true_cluster string, predicted_cluster string, gt_index int, pred_index int, top5 array<struct<cluster string, prob double>>, true_prob double, true_rank int, true_in_vocab boolean, true_in_top5 boolean>>",
    "blank_control": f"ground_truth string, image_path string, real struct<{_CONFIDENCE}>, blank struct<{_CONFIDENCE}>, noise struct<{_CONFIDENCE}>",
    "training_curve": "script string, condition string, seed int, steps array<int>, n_samples int, points array<struct<step int, checkpoint string, training_loss double, mean_confidence_real double, mean_confidence_blank double, real_minus_blank_gap double, accuracy double, n_samples int>>, interpretation string",
    "calibration": "records array<struct<confidence double, correct boolean, prediction string, ground_truth string>>, buckets array<struct<range array<double>, n int, accuracy double>>",
    "zero_shot": f"condition string, {_EVAL}, ground_truth_script string, {_CONFIDENCE}, step_confidences array<double>, charset_composition struct<n_graphemes int, n_trained_script int, n_image_script int, n_other int, trained_script_fraction double, image_script_fraction double, other_fraction double>",
    "synthetic_real": f"condition string, {_EVAL}, {_CONFIDENCE}, step_confidences array<double>, correct boolean, checkpoint_path string, leakage_free boolean",
    "ablation": f"{_EVAL}, text_full string, text_zero string, mean_confidence_full double, mean_confidence_zero double, step_metrics array<struct<step int, kl_full_given_zero double, kl_zero_given_full double, top1_agree boolean, prior_sufficiency double, max_p_full double, max_p_zero double>>",
    "likelihood": f"{_EVAL}, condition string, estimator string, n_gt_tokens int, mean_log_p_gt double, mean_entropy double, sum_log_p_gt double, step_log_p_gt array<double>, step_entropy array<double>, n_rare_forced int, step_p_gt array<double>",
    "position_zero": "seed int, image_path string, image_id string, ground_truth string, paired_image_id string, p_gt_derange double, argmax_id int, gt_id int, p_gt double, gt_rank double, entropy_nats double, vocab_size int",
    "ngram_kl": f"{_EVAL}, condition string, n_gt_tokens int, step_kl_m_5gram array<double>, step_argmax_agree array<boolean>, step_entropy array<double>, step_p_gt array<double>, estimator string",
    "extract_pages": "script string, condition string, image_id string, image_path string, ground_truth string, language_code string, cached boolean, job_id string, sarvam_status string, sarvam_text string, confidence double, usage struct<pages_total int, pages_processed int, pages_succeeded int, pages_failed int, pages_discarded int>, error string",
    "layout_bank": "source string, source_id string, category string, page_index int, page_width int, page_height int, regions array<struct<name string, x double, y double, width double, height double, reading_order int, kind string>>",
    "resample": "mode string, tv_distance double, within_tolerance boolean, tolerance double, n_texts int, natural map<string,double>, target map<string,double>, realized map<string,double>, texts array<string>",
    "table_cells": "table_id string, row int, col int, text string, x0 double, y0 double, x1 double, y1 double",
    "rewards": "image_path string, gt string, hyp string, hyp_empty boolean, prompt_len int, reward double, char_acc double, emitted_acc double, acc_used string, teds double, tau double, coverage double, lambda_coverage double, reward_lambda0 double",
}
