"""Fixed values of the checks and rules, written down a second time for the
oracle SQL: a wrong constant in the library then shows as a mismatch."""

# Fixed values.
CHECK_NAMES = ('Missing Values',
 'Duplicate Rows',
 'Duplicate Columns',
 'Zero Variance Variables',
 'Sparse Variables',
 'Date Integrity',
 'Outliers (IQR Method)',
 'Unexpected Null Patterns',
 'Mixed Data Types',
 'High Cardinality Categoricals',
 'Negative Values in Positive-Expected Fields',
 'Overall Population Coverage')
CATEGORY_RULES = (('Identifiers', '_id$|^id$|_no$|_num$|_ref$|_code$|identifier|serial|uuid|sku'),
 ('Dates', 'date|_dt$|^dt_|year|month|quarter|inception|expiry|renewal|start|end'),
 ('Claims', 'claim|clm|loss|paid|payment|reimburs|benefit|settlement|indemnity'),
 ('Exposure', 'exposure|expo|earned|duration|days_at_risk|risk_days|in_force|lapse'),
 ('Premium', 'premium|prm|gwp|nwp|written|price|rate|tariff|contribution'),
 ('Customer', 'customer|client|member|insured|policyholder|holder'),
 ('Policy', 'policy|cover|coverage|plan_type|product_code|scheme'),
 ('Product', 'product|line_of_business|lob|class|subclass|tier'),
 ('Pet', 'pet|breed|species|animal|cat\\b|dog\\b|rabbit'),
 ('Geography', 'province|state|region|country|postcode|zip|city|area|territory|district'),
 ('Behavioural', 'tenure|vintage|age|gender|sex|occupation|income|channel|source'),
 ('Potential Leakage', 'future|next_|post_claim|after_claim|outcome'),
 ('Potential Targets', 'target|label|y_|flag|indicator|propensity'))
LEAKAGE_OVERRIDE = 'future|post_claim|outcome|next_period|after_loss'
CLAIM_AMOUNT = 'claim.?(amount|paid|value|cost|payment|benefit|settlement|indemnity)|paid.?amount|loss.?amount|benefit.?amount|total.?paid|amount.?paid|incurred'
CLAIM_FLAG = 'has_claim|claim_flag|claimed|is_claim|clm_flag|claim_indicator'
CLAIM_COUNT = 'claim.?(count|cnt|num|number|freq|flag)|n_claims|num_claims|claims_count|clm_cnt'
CUSTOMER_EXACT = ('customer_id', 'client_id')
CUSTOMER_PATTERN = 'cust.?(id|no|num|ref)|customer.?id|client.?id'
META_CLAIM = 'claim.?(amount|paid|cost|value|cnt|count)'
POLICY_EXACT = ('policy_id', 'policy_no', 'policyid')
POLICY_PATTERN = 'policy.?(id|no|num|number|ref)'
FREQ_FLAG = 'claim.?(flag|ind|indicator|binary)|has.?claim|is.?claim|clm.?flag'
FREQ_COUNT = 'claim.?(count|cnt|num|freq)|n.?claim|num.?claim'
SEV_AMOUNT = 'claim.?(amount|paid|value|cost)|paid.?amount|loss.?amount|incurred'
SEV_COUNT = 'claim.?(count|cnt|num)|n.?claim|num.?claim'
EL_SEVERITY = 'claim.?(amount|paid|value|incurred|cost)'
EL_EXPOSURE = 'exposure|expo|earned|duration|days_at_risk'
EL_FREQUENCY = 'claim.?(count|cnt|freq|num)|n.?claim'
RETENTION = 'lapse|churn|cancel|renew|retain|termination|policy.?end'
LEAKAGE = 'future|post.?claim|after.?claim|next.?period|outcome|result|paid.?amount|total.?paid|benefit.?paid|loss.?ratio|claim.?ratio'
SUSPICIOUS = 'loss.?ratio|combined.?ratio|profit|margin|expense.?ratio|settlement.?ratio'
HIGH_VALUE = 'age|pet.?age|animal.?age|gender|sex|breed|province|state|region|plan|product|vintage|tenure|channel|income|occupation|sum.?insured|coverage.?amount'
HIGH_VALUE_CATEGORIES = ('Geography', 'Pet', 'Behavioural', 'Product', 'Policy')
FEATURE_RANK = (('Potential Leakage', 0), ('Suspicious', 1), ('Low Value', 2), ('High Value', 3), ('Modelling Feature', 4))
ROADMAP_STEPS = (('portfolio', 'Portfolio Overview', 'High', 'Low', 'High'),
 ('remediation', 'Data Quality Remediation', 'High', 'Medium', 'High'),
 ('exposure', 'Exposure Analysis', 'High', 'Medium', 'High'),
 ('claims_validation', 'Claims Validation', 'High', 'Low', 'High'),
 ('claims_overview', 'Claims Overview', 'High', 'Low', 'High'),
 ('severity', 'Claim Severity Analysis', 'High', 'Medium', 'High'),
 ('frequency', 'Claim Frequency Analysis', 'High', 'Medium', 'High'),
 ('geography', 'Geographic Analysis', 'Medium', 'Medium', 'High'),
 ('pet', 'Breed & Species Risk Analysis', 'Medium', 'Medium', 'High'),
 ('premium', 'Premium & Pricing Analysis', 'Medium', 'Medium', 'High'),
 ('trends', 'Experience Trends Over Time', 'Medium', 'Medium', 'Medium'),
 ('expected_loss', 'Expected Loss (Pure Premium) Analysis', 'High', 'Medium', 'High'),
 ('segmentation', 'Risk Segmentation & Clustering', 'Medium', 'High', 'Medium'),
 ('targets', 'Target Variable Analysis ({n} candidates)', 'High', 'Medium', 'High'),
 ('modelling', 'Modelling Readiness Assessment', 'Medium', 'Low', 'High'))
HEATMAP_CATEGORIES = ('Geography', 'Product', 'Pet', 'Customer', 'Policy')
