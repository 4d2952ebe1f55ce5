"""Fixed values of the sequence model."""

import math

ALPHABET = 95
MAX_ID = ALPHABET - 1
CLASSES = 2 * ALPHABET - 1
SHIFT = MAX_ID
Q_BOS, R_BOS = ALPHABET, CLASSES
Q_TOKENS, R_TOKENS = ALPHABET + 1, CLASSES + 1
Q_KS, R_KS = (2, 3, 4), (2, 3, 4, 6)
STRIDE, VOCAB = 1, 4096
Q_BASE, Q_BOS_BUCKET = 8, 7
R_BASE, R_BOS_BUCKET = 12, 11
CONTINUOUS = CLASSES + 5
PAD_TARGET = -100
EPS = 1e-12
LENGTH_CAP = 10_000
CONTEXT = 256
TRAIN_FRACTION = 0.8
SEED = 20260715
LN2 = math.log(2.0)
