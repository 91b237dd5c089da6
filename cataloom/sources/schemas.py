"""Business dataset schemas the reference creates: one seeded entity table
(25 columns), 20 vendor cards and 10 wide cards - 31 tables, 518 columns.

Fixed values that must equal the reference's DDL (column names and types),
as Spark DDL text, in the reference's order."""

from __future__ import annotations

# Table -> DDL.
BUSINESS_DDL = {
    "entity_001": (
        "id bigint, username string, full_name string, email string, amount decimal(12,2), "
        "credit_score int, risk_factor double, is_active boolean, country string, "
        "payment_terms string, posted_date date, created_at timestamp_ntz, "
        "last_login timestamp_ntz, updated_at timestamp_ntz, notes string, timezone string, "
        "currency string, tags array<string>, prefs map<string,string>, login_count int, "
        "discount_pct double, lifetime_value double, segment string, status string, "
        "churn_prob double"),
    "salesforce_opportunities_1": (
        "id string, accountid string, ownerid string, name string, stagename string, "
        "amount double, closedate date, probability double, type string, leadsource string, "
        "nextstep string, forecastcategory string, isclosed boolean, iswon boolean, "
        "createddate timestamp_ntz, lastmodifieddate timestamp_ntz, description string"),
    "shopify_orders_1": (
        "id bigint, order_number string, customer_id bigint, email string, "
        "total_price decimal(12,2), currency string, financial_status string, "
        "fulfillment_status string, tags string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"),
    "zendesk_tickets_1": (
        "id bigint, subject string, description string, status string, priority string, "
        "type string, requester_id bigint, assignee_id bigint, group_id bigint, "
        "organization_id bigint, tags string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz, due_at timestamp_ntz"),
    "jira_issues_1": (
        "id bigint, issue_key string, summary string, description string, issue_type string, "
        "status string, priority string, reporter_id bigint, assignee_id bigint, "
        "created timestamp_ntz, updated timestamp_ntz, resolved timestamp_ntz"),
    "github_issues_1": (
        "id bigint, repo string, number bigint, title string, body string, state string, "
        "author_login string, assignee_login string, labels string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz, closed_at timestamp_ntz"),
    "servicenow_incidents_1": (
        "sys_id string, number string, short_description string, description string, "
        "state string, priority string, assignment_group string, assigned_to string, "
        "category string, subcategory string, opened_at timestamp_ntz, "
        "updated_at timestamp_ntz, closed_at timestamp_ntz"),
    "netsuite_transactions_1": (
        "id bigint, tran_type string, entity_id bigint, memo string, amount decimal(14,2), "
        "currency string, status string, tran_timestamp timestamp_ntz, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"),
    "postgres_customers_1": (
        "id bigint, email string, full_name string, country string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"),
    "postgres_invoices_1": (
        "id bigint, customer_id bigint, amount decimal(12,2), currency string, status string, "
        "issued_at timestamp_ntz, paid_at timestamp_ntz"),
    "googleanalytics_events_1": (
        "event_id bigint, user_id string, session_id string, event_name string, "
        "event_params string, event_timestamp timestamp_ntz"),
    "workday_positions_1": (
        "position_id string, worker_id string, title string, org string, location string, "
        "effective_date date, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "anaplan_modelexports_1": (
        "export_id string, model_id string, name string, status string, "
        "started_at timestamp_ntz, finished_at timestamp_ntz"),
    "oracleebs_gljournals_1": (
        "journal_id bigint, ledger string, period string, category string, status string, "
        "entered_dr decimal(18,2), entered_cr decimal(18,2), created_at timestamp_ntz, "
        "updated_at timestamp_ntz"),
    "sapecc_materialmaster_1": (
        "material_id string, material_type string, description string, plant string, "
        "base_uom string, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "sqlserver_clickstream_1": (
        "event_id bigint, user_id string, url string, referrer string, user_agent string, "
        "event_time timestamp_ntz"),
    "github_releases_1": (
        "id bigint, repo string, tag_name string, name string, draft boolean, "
        "prerelease boolean, published_at timestamp_ntz"),
    "zendesk_users_1": (
        "id bigint, name string, email string, role string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"),
    "shopify_customers_1": (
        "id bigint, email string, first_name string, last_name string, state string, "
        "tags string, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "servicenow_changes_1": (
        "sys_id string, number string, short_description string, description string, "
        "state string, priority string, opened_at timestamp_ntz, updated_at timestamp_ntz, "
        "closed_at timestamp_ntz"),
    "workday_compensation_1": (
        "comp_event_id string, worker_id string, comp_plan string, amount decimal(14,2), "
        "currency string, effective_date date, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"),
    "oracleebs_ar_receipts_1": (
        "receipt_id bigint, cash_receipt_id bigint, receipt_number string, "
        "customer_trx_id bigint, customer_id bigint, payer_site_use_id bigint, org_id bigint, "
        "receipt_date date, gl_date date, currency_code string, amount decimal(15,2), "
        "applied_amount decimal(15,2), unapplied_amount decimal(15,2), "
        "remittance_bank_acct string, status string, payment_method string, "
        "exchange_rate decimal(18,8), exchange_rate_type string, exchange_rate_date date, "
        "creation_date timestamp_ntz, created_by bigint, last_update_date timestamp_ntz, "
        "last_updated_by bigint, comments string, attribute1 string, attribute2 string, "
        "attribute3 string, attribute4 string, attribute5 string"),
    "oracleebs_po_headers_1": (
        "po_header_id bigint, segment1 string, type_lookup_code string, vendor_id bigint, "
        "vendor_site_id bigint, agent_id bigint, org_id bigint, ship_to_location_id bigint, "
        "bill_to_location_id bigint, currency_code string, rate decimal(18,8), rate_date date, "
        "terms_id bigint, approval_status string, authorization_status string, "
        "closed_code string, cancelled_date date, note_to_vendor string, "
        "creation_date timestamp_ntz, last_update_date timestamp_ntz"),
    "oracleebs_po_lines_1": (
        "po_line_id bigint, po_header_id bigint, line_num bigint, item_id bigint, "
        "item_description string, category_id bigint, quantity_ordered decimal(18,4), "
        "quantity_received decimal(18,4), quantity_billed decimal(18,4), "
        "unit_price decimal(18,6), uom_code string, need_by_date date, promised_date date, "
        "ship_to_location_id bigint, deliver_to_location_id bigint, charge_account_id bigint, "
        "destination_type_code string, closed_code string, cancelled_flag boolean, "
        "attribute1 string, attribute2 string, attribute3 string, attribute4 string, "
        "attribute5 string, creation_date timestamp_ntz, last_update_date timestamp_ntz"),
    "oracleebs_om_orders_1": (
        "header_id bigint, order_number bigint, order_type_id bigint, org_id bigint, "
        "sold_to_org_id bigint, ship_to_org_id bigint, invoice_to_org_id bigint, "
        "price_list_id bigint, salesrep_id bigint, currency_code string, booked_flag boolean, "
        "status_code string, ordered_date timestamp_ntz, request_date timestamp_ntz, "
        "customer_po_number string, freight_terms_code string, shipping_method_code string, "
        "tax_exempt_flag boolean, tax_exempt_number string, last_update_date timestamp_ntz, "
        "creation_date timestamp_ntz"),
    "oracleebs_inventory_items_1": (
        "inventory_item_id bigint, organization_id bigint, segment1 string, "
        "description string, item_type string, item_status string, primary_uom_code string, "
        "inventory_item_flag boolean, stock_enabled_flag boolean, transactable_flag boolean, "
        "purchasable_flag boolean, orderable_on_web_flag boolean, customer_order_flag boolean, "
        "shippable_item_flag boolean, returnable_flag boolean, planning_make_buy_code string, "
        "make_or_buy string, lead_time_cum_mfg bigint, lead_time_cum_total bigint, "
        "weight_uom_code string, unit_weight decimal(14,4), volume_uom_code string, "
        "unit_volume decimal(14,4), creation_date timestamp_ntz, last_update_date timestamp_ntz"),
    "oracle_fusion_hcm_workers_1": (
        "worker_id string, person_number string, user_guid string, first_name string, "
        "last_name string, middle_names string, preferred_name string, full_name string, "
        "gender_code string, birth_date date, nationality string, marital_status string, "
        "national_id string, email_work string, email_personal string, phone_mobile string, "
        "phone_work string, legal_entity_id string, business_unit_id string, "
        "department_id string, job_id string, position_id string, grade_id string, "
        "manager_person_id string, location_id string, assignment_status string, "
        "employment_type string, time_type string, fte decimal(5,2), "
        "salary_amount decimal(14,2), salary_currency string, pay_frequency string, "
        "hire_date date, start_date date, seniority_date date, termination_date date, "
        "rehire_date date, work_address_line1 string, work_address_line2 string, "
        "work_city string, work_state string, work_postal_code string, work_country string, "
        "home_address_line1 string, home_address_line2 string, home_city string, "
        "home_state string, home_postal_code string, home_country string, cost_center string, "
        "project_code string, manager_level string, union_member_flag boolean, "
        "expatriate_flag boolean, visa_type string, visa_expiry_date date, "
        "disability_flag boolean, veteran_status string, effective_start timestamp_ntz, "
        "effective_end timestamp_ntz, last_update_date timestamp_ntz"),
    "slack_messages_1": (
        "team_id string, channel_id string, channel_name string, message_id string, "
        "ts timestamp_ntz, user_id string, user_real_name string, is_bot boolean, "
        "bot_id string, thread_ts timestamp_ntz, parent_user_id string, text string, "
        "permalink string, reactions string, files string, client_msg_id string, "
        "subtype string, edited_ts timestamp_ntz, deleted_flag boolean, pinned_flag boolean, "
        "imported_flag boolean"),
    "db2_zos_corebank_accounts_1": (
        "acct_number string, cust_id string, acct_type string, product_code string, "
        "branch_code string, status_code string, currency_code string, open_date date, "
        "close_date date, ledger_balance decimal(18,2), available_balance decimal(18,2), "
        "overdraft_limit decimal(18,2), interest_rate decimal(9,6), "
        "accrued_interest decimal(18,2), last_stmt_date date, next_stmt_date date, "
        "last_txn_ts timestamp_ntz, risk_grade string, aml_flag boolean, kyc_flag boolean, "
        "dormant_flag boolean, hold_flag boolean, freeze_flag boolean, "
        "charge_off_flag boolean, write_off_amount decimal(18,2), days_past_due int, "
        "collections_flag boolean, tax_withhold_flag boolean, tax_withhold_rate decimal(7,4), "
        "addr_line1 string, addr_line2 string, city string, state string, postal_code string, "
        "country string, phone_home string, phone_mobile string, email_primary string, "
        "rel_manager_id string, fee_plan_code string, fee_waive_flag boolean, "
        "rewards_tier string, rewards_points bigint, escheat_flag boolean, escheat_date date, "
        "last_review_date date, next_review_date date, create_ts timestamp_ntz, "
        "update_ts timestamp_ntz, attr1 string, attr2 string, attr3 string, attr4 string, "
        "attr5 string"),
    "db2_udb_orders_1": (
        "order_id bigint, customer_id bigint, order_status string, order_date timestamp_ntz, "
        "ship_date timestamp_ntz, currency string, subtotal decimal(14,2), "
        "tax_amount decimal(14,2), shipping_amount decimal(14,2), total_amount decimal(14,2), "
        "ship_name string, ship_addr1 string, ship_addr2 string, ship_city string, "
        "ship_state string, ship_postal string, ship_country string, bill_name string, "
        "bill_addr1 string, bill_addr2 string, bill_city string, bill_state string, "
        "bill_postal string, bill_country string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"),
    "oracleebs_ar_customers_1": (
        "customer_id bigint, account_number string, party_id bigint, party_name string, "
        "customer_type string, status string, primary_site_use_id bigint, "
        "bill_to_site_use_id bigint, ship_to_site_use_id bigint, tax_reference string, "
        "payment_terms_id bigint, credit_limit decimal(15,2), credit_class string, "
        "credit_hold_flag boolean, currency_code string, phone_number string, "
        "email_address string, address_line1 string, address_line2 string, city string, "
        "state string, postal_code string, country string, creation_date timestamp_ntz, "
        "last_update_date timestamp_ntz, attribute1 string, attribute2 string, "
        "attribute3 string"),
}
