from corvid.streaming.scoring import knn_label_stream, logistic_score_stream

__all__ = ["knn_label_stream", "logistic_score_stream"]
