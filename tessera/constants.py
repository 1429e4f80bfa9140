"""Fixed values.

These must equal the reference's for the same results; they are stated here
together, as plain values, and imported where used.
"""

# Report lines printed by the parallel programs (the timing field is left out).
REPORT_SUM_FORMAT = "np=%2d;    sum=%d"
REPORT_PI_FORMAT = "np=%2d;    PI=%0.4f"

# Training: momentum optimizer, learning rate scaled by the number of workers.
LEARNING_RATE = 0.001
MOMENTUM = 0.9
BATCH_SIZE = 100
LOG_EVERY_STEPS = 500
TRAIN_STEPS = (20000, 5)       # the two step counts used, divided by the workers

# The two-convolution network.
IMAGE_SHAPE = (28, 28, 1)
KERNEL_SIZE = 5
CONV_FILTERS = (32, 64)
DENSE_UNITS = 1024
CLASSES = 10
DROPOUT_RATE = 0.4

# Closed-form fixture weights used by the tests and queries:
# w[k][j] = ((7k + 3j) % 11 - 5) / 10
